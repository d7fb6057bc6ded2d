"""Population stability, value buckets, weight of evidence, stability over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import iv_strength, normalize_missing, psi_label, value_transform, woe_half_width
from riskloom.operators.ranking import ranking_metrics
from riskloom.plans.relational import deviation, long_form, no_nan, one_row, quantiles, running, safe_div

MISSING_BIN = "NaN"


def _inner(bins: int) -> list[float]:
    return [k / bins for k in range(1, bins)]


def quantile_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the distinct inner edges of equal-mass bins."""
    found = quantiles(df, column, _inner(bins)).select(F.array_distinct("quantiles").alias("edges"))
    return one_row(found).select(F.coalesce("edges", F.array().cast("array<double>")).alias("edges"))


def bin_number(x: Column, edges: Column) -> Column:
    """1-based number of the right-closed bin, 0 for missing values."""
    return F.when(x.isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < x)) + 1)


def edge_text(x: float) -> str:
    return f"{x:.4g}"


def bin_labels(edges: Sequence[float]) -> list[str]:
    ends = ["-inf", *map(edge_text, edges), "inf"]
    return [f"{k + 1:02d}: ({a}, {b}{']' if k < len(edges) else ')'}" for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def _psi_terms(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares and psi of (keys, bin, expected, actual): a bin empty on one side counts as 1, totals stay as they are."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    filled = counts.withColumn("e_all", F.sum("expected").over(w)).withColumn("a_all", F.sum("actual").over(w)).filter("expected + actual > 0")
    e = safe_div(F.greatest("expected", F.lit(1)), F.col("e_all"))
    a = safe_div(F.greatest("actual", F.lit(1)), F.col("a_all"))
    return filled.withColumn("expected_share", e).withColumn("actual_share", a).withColumn("psi", (a - e) * F.ln(a / e)).drop("e_all", "a_all")


def psi_table(df: DataFrame, column: str, is_expected: Column, bins: int = 10) -> DataFrame:
    """Bins of one column with counts, shares and psi; edges come from the expected rows only. Strings are categories."""
    marked = df.withColumn("__e", is_expected)
    if isinstance(df.schema[column].dataType, T.StringType):
        rows = marked.select("__e", F.coalesce(normalize_missing(F.col(column)), F.lit(MISSING_BIN)).alias("bin"))
    else:
        edges = quantile_edges(marked.filter("__e"), column, bins)
        rows = marked.crossJoin(F.broadcast(edges)).select("__e", bin_number(no_nan(F.col(column).cast("double")), F.col("edges")).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count_if("__e").alias("expected"), F.count_if(~F.col("__e")).alias("actual"))
    return _psi_terms(counts, [])


def psi(df: DataFrame, column: str, is_expected: Column, bins: int = 10) -> DataFrame:
    """One row: psi, null if either side is empty."""
    return psi_table(df, column, is_expected, bins).agg(F.sum("psi").alias("psi"))


def psi_from_counts(expected: DataFrame, actual: DataFrame, bin_col: str = "bin", count: str = "n") -> DataFrame:
    both = expected.select(bin_col, F.col(count).alias("expected")).join(actual.select(bin_col, F.col(count).alias("actual")), bin_col, "full").fillna(0)
    return _psi_terms(both.withColumnRenamed(bin_col, "bin"), []).agg(F.sum("psi").alias("psi"))


def feature_psi(df: DataFrame, features: Sequence[str], is_expected: Column, bins: int = 10, period: str | None = None) -> DataFrame:
    """feature, psi, status of all features in one pass for numbers and one for categories; by ``period`` of the actual rows if given."""
    strings = [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]
    numbers = [f for f in features if f not in strings]
    marked = df.withColumn("__e", is_expected).withColumn("__p", F.col(period) if period else F.lit(None).cast("timestamp"))
    parts = []
    if numbers:
        rows = long_form(marked.withColumns({f: no_nan(F.col(f).cast("double")) for f in numbers}), ["__e", "__p"], numbers)
        edges = quantiles(rows.filter("__e"), "value", _inner(bins), ["feature"]).select("feature", F.array_distinct("quantiles").alias("edges"))
        parts.append(rows.join(edges, "feature", "left").select("__e", "__p", "feature", bin_number(F.col("value"), F.coalesce("edges", F.array().cast("array<double>"))).cast("string").alias("bin")))
    if strings:
        rows = long_form(marked, ["__e", "__p"], strings, cast="string")
        parts.append(rows.select("__e", "__p", "feature", F.coalesce(normalize_missing(F.col("value")), F.lit(MISSING_BIN)).alias("bin")))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if not period:
        counts = rows.groupBy("feature", "bin").agg(F.count_if("__e").alias("expected"), F.count_if(~F.col("__e")).alias("actual"))
        out = _psi_terms(counts, ["feature"]).groupBy("feature").agg(F.sum("psi").alias("psi"))
        return out.withColumn("status", psi_label(F.col("psi")))
    expected = rows.filter("__e").groupBy("feature", "bin").agg(F.count("*").alias("expected"))
    actual = rows.filter("NOT __e AND __p IS NOT NULL").groupBy("feature", F.col("__p").alias("period"), "bin").agg(F.count("*").alias("actual"))
    grid = actual.select("feature", "period").distinct().join(expected, "feature")
    counts = grid.join(actual, ["feature", "period", "bin"], "full").fillna(0, ["expected", "actual"])
    return _psi_terms(counts, ["feature", "period"]).groupBy("feature", "period").agg(F.sum("psi").alias("psi")).withColumn("status", psi_label(F.col("psi")))


def psi_by_period(df: DataFrame, column: str, date: str, freq: str = "month", bins: int = 10, mode: str = "reference", reference: Column | None = None) -> DataFrame:
    """psi of a numeric column by period.

    mode ``reference``: against the rows of ``reference``, or the first period; ``adjacent``:
    against the period before, with edges from that period; the first has none.
    """
    x = df.filter(F.col(date).isNotNull()).select(F.date_trunc(freq, date).alias("period"), no_nan(F.col(column).cast("double")).alias("x"), (reference if reference is not None else F.lit(None).cast("boolean")).alias("r"))
    if mode == "reference":
        base = x.filter("r") if reference is not None else x.join(F.broadcast(x.agg(F.min("period").alias("period"))), "period", "left_semi")
        edges = F.broadcast(quantile_edges(base, "x", bins))
        binned = lambda t: t.crossJoin(edges).withColumn("bin", bin_number(F.col("x"), F.col("edges")))
        expected = binned(base).groupBy("bin").agg(F.count("*").alias("expected"))
        actual = binned(x).groupBy("period", "bin").agg(F.count("*").alias("actual"))
        grid = actual.select("period").distinct().crossJoin(F.broadcast(expected))  # one row a bin
        counts = grid.join(actual, ["period", "bin"], "full").fillna(0, ["expected", "actual"])
        return _psi_terms(counts, ["period"]).groupBy("period").agg(F.sum("psi").alias("psi"))
    if mode != "adjacent":
        raise ValueError("mode is reference or adjacent")
    found = quantiles(x, "x", _inner(bins), ["period"]).select("period", F.array_distinct("quantiles").alias("edges"))
    edges = x.select("period").distinct().join(found, "period", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))
    steps = edges.select("period", "edges", F.lead("period").over(W.partitionBy(F.lit(0)).orderBy("period")).alias("next"))
    old = x.join(steps.filter("next IS NOT NULL"), "period").select(F.col("next").alias("period"), bin_number(F.col("x"), F.col("edges")).alias("bin"), F.lit(1).alias("e"))
    new = x.join(steps.filter("next IS NOT NULL").select(F.col("next").alias("period"), "edges"), "period").select("period", bin_number(F.col("x"), F.col("edges")).alias("bin"), F.lit(0).alias("e"))
    counts = old.union(new).groupBy("period", "bin").agg(F.sum("e").alias("expected"), F.count_if(F.col("e") == 0).alias("actual"))
    found = _psi_terms(counts, ["period"]).groupBy("period").agg(F.sum("psi").alias("psi"))
    return edges.select("period").join(found, "period", "left")


def greedy_bounds(df: DataFrame, column: str, buckets: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Upper values of greedy equal-mass buckets that never split a value: keys, uppers (array).

    From each bound the next is the first value that completes an equal share of what is left. The
    histogram of distinct values is summed up once, range by range, and kept; each bound of all
    groups is then one aggregation of it. Only the bounds, ``buckets`` a group, reach the driver.
    """
    by = list(by)
    spark = df.sparkSession
    h = df.select(*by, no_nan(F.col(column).cast("double")).alias("x")).filter("x IS NOT NULL").groupBy(*by, "x").agg(F.count("*").alias("n"))
    cum = running(h, by, "x", {"c": F.col("n")}).select(*by, "x", "c", F.col("c_all").alias("tot")).persist()
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema] if by else []
    uppers: dict[tuple, list[float]] = {}
    reached: dict[tuple, tuple[int, int]] = {}
    try:
        for left in range(buckets, 0, -1):
            if uppers and all(b >= total for b, total in reached.values()):
                break
            if uppers:
                now = spark.createDataFrame([(*k, b) for k, (b, total) in reached.items() if b < total], ", ".join([*kinds, "b long"]))
                rows = cum.join(F.broadcast(now), [cum[c].eqNullSafe(now[c]) for c in by]).select(*[cum[c] for c in by], "x", "c", "tot", "b") if by else cum.crossJoin(F.broadcast(now))
            else:
                rows = cum.withColumn("b", F.lit(0).cast("long"))
            enough = (F.col("c") - F.col("b")).cast("double") >= (F.col("tot") - F.col("b")) / F.lit(float(left))
            fits = F.col("c") == F.col("tot") if left <= 1 else enough
            for r in rows.filter(fits).groupBy(*by).agg(F.min("x").alias("x_"), F.min("c").alias("c_"), F.max("tot").alias("tot_")).collect():
                if r["x_"] is None:
                    continue
                key = tuple(r[c] for c in by)
                uppers.setdefault(key, []).append(r["x_"])
                reached[key] = (r["c_"], r["tot_"])
            if not uppers:
                break
    finally:
        cum.unpersist()
    return spark.createDataFrame([(*k, v) for k, v in uppers.items()], ", ".join([*kinds, "uppers array<double>"]))


def quantile_buckets(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """``df`` with ``bucket``: greedy equal-mass bucket from 0, -1 for missing values."""
    uppers = greedy_bounds(df, column, buckets)
    x = no_nan(F.col(column).cast("double"))
    b = F.when(x.isNull(), -1).otherwise(F.size(F.filter("uppers", lambda u: u < x)))
    return df.crossJoin(one_row(uppers)).withColumn("bucket", b).drop("uppers")


def uniform_buckets(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """``df`` with ``bucket``: equal-width bucket from 0, numbered without gaps, -1 for missing values; a constant is bucket 0."""
    x = no_nan(F.col(column).cast("double"))
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    inner = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.col("__lo") + i * ((F.col("__hi") - F.col("__lo")) / buckets)) if buckets > 1 else F.array().cast("array<double>")
    raw = F.when(x.isNull(), -1).when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.size(F.filter("__inner", lambda e: e <= x)))
    placed = df.crossJoin(F.broadcast(ends.withColumn("__inner", inner))).withColumn("__raw", raw).drop("__lo", "__hi", "__inner")
    used = placed.select("__raw").distinct().withColumn("bucket", F.when(F.col("__raw") < 0, -1).otherwise(F.dense_rank().over(W.partitionBy(F.col("__raw") < 0).orderBy("__raw")) - 1))
    return placed.join(F.broadcast(used), "__raw").drop("__raw")  # one row a bucket


def woe_iv_table(df: DataFrame, bucket: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bad, good, bad_rate, shares, woe, iv by bucket. Zero counts become 1e-5; totals stay as they are."""
    by = list(by)
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    t = df.groupBy(*by, F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("bad")).withColumn("good", F.col("n") - F.col("bad"))
    floor = lambda c: F.when(F.col(c) == 0, 1e-5).otherwise(F.col(c).cast("double"))
    t = t.withColumn("bad_share", safe_div(floor("bad"), F.sum("bad").over(w))).withColumn("good_share", safe_div(floor("good"), F.sum("good").over(w)))
    t = t.withColumn("bad_rate", F.col("bad") / F.col("n")).withColumn("woe", F.ln(safe_div(F.col("bad_share"), F.col("good_share"))))
    return t.withColumn("iv", (F.col("bad_share") - F.col("good_share")) * F.col("woe"))


def iv_table(df: DataFrame, features: Sequence[str], target: str, buckets: int = 10) -> DataFrame:
    """feature, iv, strength of numeric features over greedy buckets, all features in one plan."""
    rows = long_form(df.withColumn("__y", F.col(target).cast("int")), ["__y"], features).withColumn("value", no_nan(F.col("value")))
    uppers = greedy_bounds(rows, "value", buckets, by=["feature"])
    b = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("uppers", lambda u: u < F.col("value"))))
    placed = rows.join(F.broadcast(uppers), "feature", "left").withColumn("b", b)  # bounds came through the driver
    out = woe_iv_table(placed, "b", "__y", by=["feature"]).groupBy("feature").agg(F.sum("iv").alias("iv"))
    return out.withColumn("strength", iv_strength(F.col("iv")))


def bucket_ranges(df: DataFrame, column: str, bucket: str = "bucket") -> DataFrame:
    """bucket, least and largest value, and a label."""
    t = df.groupBy(bucket).agg(F.min(column).alias("least"), F.max(column).alias("largest"))
    text = F.when(F.col(bucket) == -1, F.lit(f"{column} is null")).otherwise(F.format_string(f"{column} in [%.4g, %.4g]", F.col("least").cast("double"), F.col("largest").cast("double")))
    return t.withColumn("label", text)


def stability_table(df: DataFrame, column: str, target: str, date: str, freq: str = "month", buckets: int = 5, uniform: bool = False, null_bucket: bool = True, continuous: bool = False, transform: dict | None = None, avoid_null: bool = True, z: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(by period and bucket, by period). Buckets are fixed on all rows, psi compares with the existing period before.

    A binary target gives bad rates, woe and iv; a continuous one medians, 45 and 55 % quantiles and r2.
    """
    rows = df.select(F.date_trunc(freq, date).alias("period"), value_transform(no_nan(F.col(column).cast("double")), **(transform or {})).alias("x"), F.col(target).cast("double").alias("y")).filter("period IS NOT NULL")
    rows = rows.filter("y IS NOT NULL")
    if continuous or not null_bucket:
        rows = rows.filter("x IS NOT NULL")
    placed = (uniform_buckets if uniform else quantile_buckets)(rows, "x", buckets)
    w = W.partitionBy("period")
    if continuous:
        q = quantiles(placed, "y", [0.5, 0.45, 0.55], ["period", "bucket"])
        cells = placed.groupBy("period", "bucket").agg(F.count("*").alias("n")).join(q, ["period", "bucket"], "left").select("period", "bucket", "n", *[F.get("quantiles", k).alias(c) for k, c in enumerate(("median", "q45", "q55"))])
        c = safe_div(F.covar_pop("x", "y"), deviation(F.col("x")) * deviation(F.col("y")))
        periods = placed.groupBy("period").agg(F.count("*").alias("n"), F.when(F.count("*") > 2, c * c).alias("r2"))
    else:
        cells = woe_iv_table(placed, "bucket", "y", by=["period"]).drop("bad_share", "good_share")
        if not avoid_null:
            some = (F.col("bad") > 0) & (F.col("good") > 0)
            cells = cells.withColumn("woe", F.when(some, F.col("woe"))).withColumn("iv", F.when(some, F.col("iv")))
        rate = F.col("bad_rate")
        cells = cells.withColumn("bad_rate_ci", z * F.sqrt(rate * (1 - rate) / F.col("n"))).withColumn("woe_ci", woe_half_width(F.col("bad"), F.col("good"), z))
        periods = cells.groupBy("period").agg(F.sum("n").alias("n"), F.sum("iv").alias("iv"))
    cells = cells.withColumn("share", F.col("n") / F.sum("n").over(w))
    order = periods.select("period", F.lag("period").over(W.partitionBy(F.lit(0)).orderBy("period")).alias("before"))
    now = cells.select("period", "bucket", F.col("n").alias("actual"))
    old = order.filter("before IS NOT NULL").join(cells.select(F.col("period").alias("before"), "bucket", F.col("n").alias("expected")), "before").select("period", "bucket", "expected")
    both = now.join(order.filter("before IS NOT NULL").select("period"), "period", "left_semi").join(old, ["period", "bucket"], "full").fillna(0, ["actual", "expected"])
    moved = _psi_terms(both, ["period"]).groupBy("period").agg(F.sum("psi").alias("psi"))
    return cells, periods.join(moved, "period", "left")


def null_flag_stability(df: DataFrame, column: str, target: str, date: str, freq: str = "month") -> tuple[DataFrame, DataFrame]:
    """The stability table of "is missing", always two even buckets."""
    flagged = df.withColumn("__flag", no_nan(F.col(column).cast("double")).isNull().cast("double"))
    return stability_table(flagged, "__flag", target, date, freq, buckets=2, uniform=True)


def information_value(df: DataFrame, column: str, target: str, buckets: int = 10, method: str = "quantile") -> DataFrame:
    """One row: iv over quantile or dense buckets; method ``auc`` gives the AUC to put through iv_from_auc."""
    if method == "auc":
        return ranking_metrics(df, target, column).select("auc")
    placed = (uniform_buckets if method == "dense" else quantile_buckets)(df, column, buckets)
    return woe_iv_table(placed, "bucket", target).agg(F.sum("iv").alias("iv"))
