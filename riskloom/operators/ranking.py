"""Discrimination metrics as grouped aggregates over value histograms."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions.columns import numeric
from riskloom.plans.relational import long_form, quantiles, running, safe_div


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n, n_target, auc, gini, ks, pr_auc by group: one histogram of (group, score), then running sums.

    Ties share their credit; a group of one class has null metrics. Rows without label or score are left out; a row counts ``weight`` times.
    """
    by = list(by)
    rows = df.select(*by, F.col(label).cast("long").alias("__y"), F.col(score).cast("double").alias("__s"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")).filter("__y IS NOT NULL AND __s IS NOT NULL")
    h = rows.groupBy(*by, "__s").agg(F.sum("__w").alias("__n"), F.sum(F.col("__y") * F.col("__w")).alias("__p"))
    c = running(h, by, "__s", {"__cn": F.col("__n") - F.col("__p"), "__cp": F.col("__p")})
    neg, pos = F.col("__n") - F.col("__p"), F.col("__p").cast("double")
    above_p, above_n = F.col("__cp_all") - F.col("__cp") + F.col("__p"), F.col("__cn_all") - F.col("__cn") + neg
    n_p, n_n = F.max("__cp_all"), F.max("__cn_all")
    auc = safe_div(F.sum(pos * (F.col("__cn") - neg / 2)), n_p.cast("double") * n_n)
    ks = F.max(F.abs(safe_div(F.col("__cp"), F.col("__cp_all")) - safe_div(F.col("__cn"), F.col("__cn_all"))))
    ap = safe_div(F.sum(pos * above_p / (above_p + above_n)), n_p)
    out = c.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum("__p").alias("n_target"), auc.alias("auc"), ks.alias("ks"), ap.alias("pr_auc"))
    two = (F.col("n_target") > 0) & (F.col("n_target") < F.col("n"))
    return out.select(*by, "n", "n_target", F.when(two, F.col("auc")).alias("auc"), F.when(two, 2 * F.col("auc") - 1).alias("gini"), F.when(two, F.col("ks")).alias("ks"), F.when(F.col("n_target") > 0, F.col("pr_auc")).alias("pr_auc"))


def losses(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """logloss (scores kept off 0 and 1 by 1e-15) and brier by group."""
    p, y = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15)), F.col(label)
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*by).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))


def lift(df: DataFrame, label: str, score: str, key: str, share: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Target rate among the top share of scores (at least one row, ties by key) over that of all.

    The cut is found on the histogram of scores; rows are ordered only inside the score that it falls on.
    """
    by = list(by)
    rows = df.select(*by, F.col(label).cast("long").alias("__y"), F.col(score).cast("double").alias("__s"), F.col(key).alias("__k")).filter("__y IS NOT NULL AND __s IS NOT NULL")
    h = rows.groupBy(*by, "__s").agg(F.count("*").alias("__n"), F.sum("__y").alias("__p"))
    c = running(h, by, "__s", {"__c": F.col("__n"), "__cp": F.col("__p")})
    k = F.greatest(F.lit(1), F.bround(F.col("__c_all") * F.lit(float(share)))).cast("long")
    above = F.col("__c_all") - F.col("__c")
    cut = c.withColumn("__take", F.least(F.greatest(k - above, F.lit(0)), F.col("__n"))).withColumn("__k_rows", k)
    whole = cut.filter("__take = __n").groupBy(*by).agg(F.sum("__p").alias("__full"))
    edge = cut.filter("__take > 0 AND __take < __n").select(*[F.col(b).alias(f"__e_{b}") for b in by], F.col("__s").alias("__e_s"), "__take")
    on = [rows["__s"] == edge["__e_s"], *[rows[b].eqNullSafe(edge[f"__e_{b}"]) for b in by]]
    part = rows.join(edge, on).withColumn("__r", F.row_number().over(W.partitionBy(*by, "__s").orderBy("__k"))).filter("__r <= __take").groupBy(*by).agg(F.sum("__y").alias("__partial"))
    total = cut.groupBy(*by).agg(F.max("__c_all").alias("n"), F.max("__cp_all").alias("n_target"), F.max("__k_rows").alias("k"))
    if by:
        joined = total.join(whole, by, "left").join(part, by, "left")
    else:
        joined = total.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(part))
    top = F.coalesce("__full", F.lit(0)) + F.coalesce("__partial", F.lit(0))
    return joined.select(*by, "n", "n_target", "k", safe_div(top / F.col("k"), F.col("n_target") / F.col("n")).alias("lift"))


@dataclass(frozen=True)
class Metric:
    """A named metric: ``func(df, label, score, by, key)`` gives the keys and one column ``value``; ``counted(df, label, score, by, weight)`` does for rows that stand for several."""

    name: str
    func: Callable
    greater_is_better: bool = True
    counted: Callable | None = None

    def delta(self, new: float, old: float) -> float:
        """Improvement, positive when better."""
        return (new - old) if self.greater_is_better else (old - new)


def _ranked(column: str) -> Callable:
    return lambda df, label, score, by=(), key=None: ranking_metrics(df, label, score, by).select(*by, F.col(column).alias("value"))


def _loss(column: str) -> Callable:
    return lambda df, label, score, by=(), key=None: losses(df, label, score, by).select(*by, F.col(column).alias("value"))


def _counted(column: str) -> Callable:
    return lambda df, label, score, by, weight: ranking_metrics(df, label, score, by, weight).select(*by, F.col(column).alias("value"))


METRICS = {m.name: m for m in (*(Metric(n, _ranked(c), counted=_counted(c)) for n, c in (("roc_auc", "auc"), ("gini", "gini"), ("ks", "ks"), ("pr_auc", "pr_auc"))), Metric("logloss", _loss("logloss"), False), Metric("brier", _loss("brier"), False))}


def custom_metric(func: Callable, name: str | None = None) -> Metric:
    """A metric from a function of two arrays (labels, scores), run as a grouped Arrow aggregate; a group must fit in a task."""

    def build(df, label, score, by=(), key=None):
        import pandas as pd

        def aggregate(y, p):
            return float(func(y.to_numpy(), p.to_numpy()))

        aggregate.__annotations__ = {"y": pd.Series, "p": pd.Series, "return": float}
        value = F.pandas_udf(aggregate, "double")
        return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by).agg(value(F.col(label).cast("double"), F.col(score).cast("double")).alias("value"))

    return Metric(name or getattr(func, "__name__", "metric"), build)


def get_metric(metric) -> Metric:
    """A metric by name (``lift@10%`` too), by function, or itself."""
    if isinstance(metric, Metric):
        return metric
    if callable(metric):
        return custom_metric(metric)
    if not isinstance(metric, str):
        raise TypeError(f"a metric is a name, a function or a Metric, not {type(metric).__name__}")
    if metric in METRICS:
        return METRICS[metric]
    if m := re.fullmatch(r"lift@(\d+(?:\.\d+)?)%", metric):
        share = float(m[1]) / 100
        return Metric(metric, lambda df, label, score, by=(), key="row_id": lift(df, label, score, key or "row_id", share, by).select(*by, F.col("lift").alias("value")))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)} and lift@X%")


def metrics_by_segment(df: DataFrame, label: str, score: str, segment: str, min_size: int = 0) -> DataFrame:
    """Metrics of all rows (segment ALL) and of each segment of at least ``min_size`` rows; a null segment is NaN."""
    named = df.withColumn("segment", F.coalesce(F.col(segment).cast("string"), F.lit("NaN")))
    both = named.select(F.explode(F.array(F.lit("ALL"), F.col("segment"))).alias("segment"), F.col(label).alias("y"), F.col(score).alias("p"))
    out = ranking_metrics(both, "y", "p", ["segment"])
    return out.filter((F.col("segment") == "ALL") | (F.col("n") >= min_size)).withColumn("target_rate", F.col("n_target") / F.col("n"))


def metric_dynamics(df: DataFrame, label: str, score: str, date: str, segment: str | None = None, freq: str = "month", min_size: int = 30) -> DataFrame:
    """Metrics by period and segment, null where there are fewer than ``min_size`` rows; rows without a date are left out."""
    keys = {"period": F.date_trunc(freq, date)} | ({"segment": F.coalesce(F.col(segment).cast("string"), F.lit("NaN"))} if segment else {})
    rows = df.filter(F.col(date).isNotNull()).select(*[c.alias(k) for k, c in keys.items()], F.col(label).alias("y"), F.col(score).alias("p"))
    out = ranking_metrics(rows, "y", "p", list(keys))
    enough = F.col("n") >= min_size
    return out.select(*keys, "n", "n_target", *[F.when(enough, F.col(c)).alias(c) for c in ("auc", "gini", "ks", "pr_auc")])


def compare_scores(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """auc, gini and ks of several score columns at once."""
    rows = long_form(df, [label], scores, "score", "p")
    return ranking_metrics(rows, label, "p", ["score"]).select("score", "n", "auc", "gini", "ks")


def direct_auc(df: DataFrame, label: str, features: Sequence[str], fold: str | None = None) -> DataFrame:
    """feature, direct_auc: max(AUC, 1 - AUC) of the raw value.

    With ``fold``: missing values take the median of the rows outside the fold, and folds are
    averaged. Features with fewer than two values score one half.
    """
    values = df.select(F.col(label).cast("int").alias("y"), *([F.col(fold).alias("fold")] if fold else []), *[numeric(df, c).alias(c) for c in features])
    keep = ["y", *(["fold"] if fold else [])]
    rows = long_form(values, keep, features)
    if fold:
        folds = df.select(F.col(fold).alias("out")).distinct()
        outside = rows.join(F.broadcast(folds), F.col("fold") != F.col("out"))  # one row a fold
        medians = quantiles(outside, "value", [0.5], ["feature", "out"]).select("feature", "out", F.get("quantiles", 0).alias("m"))
        joined = rows.join(medians, (rows["feature"] == medians["feature"]) & (rows["fold"] == medians["out"]), "left").select(rows["feature"], "fold", "y", F.coalesce("value", "m", F.lit(0.0)).alias("value"))
        scored = ranking_metrics(joined, "y", "value", ["feature", "fold"])
        best = F.greatest("auc", 1 - F.col("auc"))
        out = scored.groupBy("feature").agg(F.coalesce(F.avg(best), F.lit(0.5)).alias("direct_auc"))
    else:
        out = ranking_metrics(rows, "y", "value", ["feature"]).select("feature", F.coalesce(F.greatest("auc", 1 - F.col("auc")), F.lit(0.5)).alias("direct_auc"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(out, "feature", "left").select("feature", F.coalesce("direct_auc", F.lit(0.5)).alias("direct_auc"))
