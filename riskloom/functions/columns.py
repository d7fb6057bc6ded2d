"""Column functions: typing, missing values, transforms, intervals, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.mathx import normal_quantile

#: Texts that mean "missing".
MISSING = ("nan", "NaN", "None", "null", "NULL", "")
#: What every text that a cast takes for a number looks like; the cast itself decides. A cast that fails raises and catches an exception inside Spark, for each row.
NUMBER_LIKE = r"(?i)^[\x00-\x20]*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|0x.+)[df]?[\x00-\x20]*$"


def normalize_missing(x: Column) -> Column:
    """Missing tokens of a string become null."""
    return F.when(~x.isin(*MISSING), x)


def to_number(x: Column) -> Column:
    """A string's number, null if it has none. A trailing d or f, which a cast would take, is no number."""
    s = F.trim(normalize_missing(x))
    n = F.when(s.rlike(NUMBER_LIKE) & (~s.rlike("[dDfF]$") | s.rlike("(?i)inf$")), s.try_cast("double"))
    return F.nanvl(n, F.lit(None).cast("double"))


def category_strings(x: Column) -> Column:
    """Canonical text of a category: whole numbers lose their fraction; missing stays null."""
    n = to_number(x)
    return F.when(n.isNotNull() & (n == F.floor(n)), n.cast("bigint").cast("string")).otherwise(normalize_missing(x))


def category_of_number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def detect_categorical(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns with a value that is not a number: one aggregate over all of them."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]
    if not strings:
        return []
    odd = df.agg(*[F.count_if(normalize_missing(F.col(c)).isNotNull() & to_number(F.col(c)).isNull()).alias(c) for c in strings]).first()
    return [c for c in strings if odd[c]]


def is_categorical(df: DataFrame, column: str) -> bool:
    return column in detect_categorical(df.select(column))


def split_feature_types(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features in the order given."""
    found = set(detect_categorical(df.select(*features)))
    return [f for f in features if f not in found], [f for f in features if f in found]


def numeric(df: DataFrame, column: str) -> Column:
    """A feature as double: strings parsed, booleans 0 or 1, times in nanoseconds, NaN missing."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return to_number(x)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(x.cast("timestamp")) * F.lit(1000.0)
    if isinstance(kind, T.DayTimeIntervalType):
        return F.expr(f"CAST(extract(DAY FROM `{column}`) * 86400 + extract(HOUR FROM `{column}`) * 3600 + extract(MINUTE FROM `{column}`) * 60 + extract(SECOND FROM `{column}`) AS DOUBLE) * 1e9")
    n = x.cast("double")
    return F.when(~F.isnan(n), n)


def cast_types(df: DataFrame, numeric_columns: Sequence[str], categorical: Sequence[str], target: str | None = None) -> DataFrame:
    """Numeric columns as double, categorical as canonical text, the target as int."""
    kinds = dict(df.dtypes)
    text = lambda c: category_strings(F.col(c)) if kinds[c] == "string" else category_of_number(F.col(c))
    changed = {c: numeric(df, c) for c in numeric_columns} | {c: text(c) for c in categorical}
    if target:
        changed[target] = F.col(target).cast("int")
    return df.withColumns(changed)


def to_numeric_frame(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Everything that isn't categorical as double."""
    return df.withColumns({c: numeric(df, c) for c in features if c not in categorical})


def days_between(event: Column, base: Column) -> Column:
    """Whole days from base to event, by calendar date; null where either is no date."""
    date = lambda x: F.to_date(x.try_cast("timestamp"))
    return F.datediff(date(event), date(base)).cast("long")


def prob_to_logit(p: Column) -> Column:
    q = F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)))
    return F.ln(q / (1 - q))


def value_transform(x: Column, lower: float | None = None, upper: float | None = None, power: float | None = None, log: bool = False) -> Column:
    """Clip, then a signed power, then a logarithm of positive values (others become null)."""
    y = x
    if lower is not None:
        y = F.when(y.isNotNull(), F.greatest(y, F.lit(float(lower))))
    if upper is not None:
        y = F.when(y.isNotNull(), F.least(y, F.lit(float(upper))))
    if power is not None:
        y = F.signum(y) * F.pow(F.abs(y), F.lit(float(power)))
    return F.when(y > 0, F.ln(y)) if log else y


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, inside 0 to 1; null for n = 0."""
    z = normal_quantile(1 - alpha / 2)
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    centre, width, scale = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return F.when(m.isNotNull(), F.greatest((centre - width) / scale, F.lit(0.0))), F.when(m.isNotNull(), F.least((centre + width) / scale, F.lit(1.0)))


def psi_label(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "n/a").when(x < 0.1, "stable").when(x < 0.25, "moderate").otherwise("significant")


def iv_strength(x: Column) -> Column:
    return F.when(x < 0.02, "none").when(x < 0.1, "weak").when(x < 0.3, "medium").otherwise("strong")


def woe_half_width(bad: Column, good: Column, z: float = 2.576) -> Column:
    floor = lambda c: F.greatest(c.cast("double"), F.lit(1e-5))
    return z * F.sqrt(1 / floor(bad) + 1 / floor(good))


def iv_from_auc(auc: float) -> float:
    """Information value of two normal score distributions with this AUC."""
    return 2 * normal_quantile(min(max(auc, 1 - auc), 1 - 1e-12)) ** 2
