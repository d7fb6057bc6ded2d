"""Table overviews, target summaries and dynamics, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import detect_categorical, normalize_missing, numeric, wilson
from riskloom.plans.relational import deviation, no_nan, one_row, present, quantiles, settled


def overview(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, all from one histogram of (column, value): kind, missing values, distinct values, zeros, most frequent value (ties: least text), min, median, mean, max."""
    columns = list(columns or df.columns)
    df = present(df.select(*columns))
    categorical = set(detect_categorical(df))
    kinds = {f.name: f.dataType for f in df.schema}
    is_time = {c: isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType, T.DateType)) for c in columns}
    value = {c: normalize_missing(F.col(c)) if isinstance(kinds[c], T.StringType) else F.col(c) for c in columns}
    number = {c: numeric(df, c) if c not in categorical and not is_time[c] else F.lit(None).cast("double") for c in columns}
    cells = F.array(*[F.struct(F.lit(k).alias("k"), value[c].cast("string").alias("value"), (number[c] + 0.0).alias("x")) for k, c in enumerate(columns)])
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    h = settled(long.groupBy("k", "value", "x").agg(F.count("*").alias("c")))
    there = F.col("value").isNotNull()
    numbers = settled(h.filter("x IS NOT NULL").groupBy("k", "x").agg(F.sum("c").alias("c")))
    n = F.sum("c")
    stats = h.groupBy("k").agg(n.alias("n"), F.coalesce(F.sum(F.when(~there, F.col("c"))), F.lit(0)).alias("n_missing"), F.coalesce(F.sum(F.when(F.col("x") == 0, F.col("c"))), F.lit(0)).alias("n_zero"))
    # a number that is written in several ways is one value of a number, several of a text
    distinct = h.filter(there).groupBy("k").agg(F.count("*").alias("n_unique"), F.min_by(F.struct("value", F.col("c").alias("top_n")), F.struct((-F.col("c")).alias("c"), "value")).alias("t")).select("k", "n_unique", "t.*")
    spread = numbers.groupBy("k").agg(F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))
    median = quantiles(numbers, "x", [0.5], ["k"], weight="c").select("k", F.get("quantiles", 0).alias("median"))
    about = F.broadcast(df.sparkSession.createDataFrame([(k, c, kinds[c].simpleString(), bool(is_time[c]), c in categorical) for k, c in enumerate(columns)], "k int, column string, dtype string, time boolean, cat boolean"))
    stats = about.join(stats, "k", "left").fillna(0, ["n", "n_missing", "n_zero"])
    kind = F.when(F.col("n_unique") == 0, "empty").when(F.col("n_unique") == 1, "constant").when(F.col("time"), "datetime").when(F.col("cat"), "categorical").otherwise("numeric")
    numeric_kind = F.col("kind").isin("numeric", "constant") & F.col("mean").isNotNull()
    out = stats.join(distinct, "k", "left").join(spread, "k", "left").join(median, "k", "left").fillna(0, ["n_unique"]).withColumn("kind", kind)
    return out.select(
        "column", "dtype", "kind", "n_missing", (F.col("n_missing") / F.col("n")).alias("missing_share"), "n_unique",
        F.when(numeric_kind, F.col("n_zero") / F.col("n")).alias("zero_share"), F.col("value").alias("top_value"), (F.col("top_n") / F.col("n")).alias("top_share"), "min", "median", "mean", "max",
    )


def target_summary(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """n, n_target and target_rate in total or by keys; a null key is a group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("n_target"), F.avg(target).alias("target_rate"))


def target_dynamics(df: DataFrame, date: str, target: str, segment: str | None = None, freq: str = "month", alpha: float = 0.05) -> DataFrame:
    """Target rate with its Wilson interval by period and segment; rows without a date or target are left out."""
    rows = df.filter(F.col(date).isNotNull() & F.col(target).isNotNull())
    keys = [F.date_trunc(freq, date).alias("period")] + ([F.coalesce(F.col(segment).cast("string"), F.lit("NaN")).alias("segment")] if segment else [])
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_total"), F.sum(target).cast("long").alias("n_positive"))
    low, high = wilson(F.col("n_positive"), F.col("n_total"), alpha)
    return out.select("*", (F.col("n_positive") / F.col("n_total")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Counts in equal bins over the column's range, the right edge inclusive, empty bins included: bin, left, right, n."""
    x = df.select(no_nan(F.col(column).cast("double")).alias("x")).filter("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 0.5).otherwise(F.col("hi"))).withColumn("lo", F.when(F.col("hi") == F.col("lo") + 0.5, F.col("lo") - 0.5).otherwise(F.col("lo")))
    ends = ends.withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins)))
    placed = x.crossJoin(F.broadcast(ends)).select(F.least(F.greatest(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int").alias("b"), "x", "edges")
    edge = lambda k: F.get("edges", k)
    b = F.when(F.col("x") < edge(F.col("b")), F.col("b") - 1).when((F.col("b") < bins - 1) & (F.col("x") >= edge(F.col("b") + 1)), F.col("b") + 1).otherwise(F.col("b"))
    counts = placed.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = ends.select(F.posexplode(F.slice("edges", 1, bins)).alias("bin", "left"), "edges").select("bin", "left", F.get("edges", F.col("bin") + 1).alias("right"))
    return grid.join(counts, "bin", "left").select("bin", "left", "right", F.coalesce("n", F.lit(0)).alias("n"))


def clipped(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The column as x, clipped to its quantiles."""
    x = df.select(no_nan(F.col(column).cast("double")).alias("x")).filter("x IS NOT NULL")
    q = quantiles(x, "x", [low, high], name="q")
    return x.crossJoin(F.broadcast(q)).select(F.least(F.greatest("x", F.get("q", 0)), F.get("q", 1)).alias("x"))


def distribution_stats(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """n, mean, median, sample deviation and bias-adjusted skewness of the clipped column, and whether a log scale is due."""
    x = clipped(df, column, low, high)
    n = F.count("*").cast("double")
    skew = F.when((n > 2) & (deviation(F.col("x")) > 0), F.skewness("x") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(0.0))
    out = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), skew.alias("skew"), F.min("x").alias("least"))
    out = out.crossJoin(one_row(quantiles(x, "x", [0.5]).select(F.get("quantiles", 0).alias("median"))))
    return out.select("n", "mean", "median", "std", "skew", ((F.col("skew") > 2) & (F.col("least") > 0)).alias("log_scale"))


def distribution(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, bins: int = 100, log_scale: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(histogram, statistics) of the clipped column; values in logs if asked for or due."""
    stats, x = distribution_stats(df, column, low, high), clipped(df, column, low, high)
    if log_scale is None:
        log_scale = bool(stats.first()["log_scale"])
    return histogram(x.select(F.ln("x").alias("x")) if log_scale else x, "x", bins), stats


def target_by_bins(df: DataFrame, column: str, target: str, bins: int = 10) -> DataFrame:
    """Target mean and size by quantile bins (right ends inclusive); missing values are bin -1."""
    x = df.select(no_nan(F.col(column).cast("double")).alias("x"), F.col(target).alias("y"))
    edges = quantiles(x, "x", [k / bins for k in range(1, bins)]).select(F.array_distinct("quantiles").alias("edges"))
    b = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e < F.col("x"))))
    return x.crossJoin(one_row(edges)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("target_rate"))
