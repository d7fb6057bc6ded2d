"""Calibration of scores: gain charts, offsets, logistic recalibration, Hosmer-Lemeshow."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.mathx import chi2_tail
from riskloom.operators.ranking import ranking_metrics
from riskloom.plans.relational import quantiles


def sigmoid(x):
    return 1 / (1 + F.exp(-x))


def logit_buckets(df: DataFrame, logit: str, buckets: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``bucket``: quantile bucket of the logit, 1 the highest; equal edges fall together."""
    by = list(by)
    found = quantiles(df, logit, [k / buckets for k in range(buckets + 1)], by)
    edges = found.select(*by, F.array_distinct(F.slice("quantiles", 2, buckets)).alias("__edges"), F.get("quantiles", 0).alias("__least"))
    joined = df.join(edges, by) if by else df.crossJoin(F.broadcast(edges))
    # pandas-like quantile cut: edges start at the minimum, which belongs to the first bucket
    ends = F.filter("__edges", lambda e: e > F.col("__least"))
    code = F.size(F.filter(ends, lambda e: e < F.col(logit)))
    n = F.greatest(F.size(ends), F.lit(1))
    return joined.withColumn("bucket", (n - code).cast("int")).drop("__edges", "__least")


def gain_chart_table(df: DataFrame, logit: str, target: str, buckets: int = 10, by: Sequence[str] = (), offset: float | None = None, slope: float | None = None, shift: float | None = None, z: float = 2.5758) -> DataFrame:
    """By bucket: n, n_target, badrate, ci, pred and, with the given parameters, calibrated and full_calibrated predictions, and the bucket's logits."""
    rows = logit_buckets(df, logit, buckets, by)
    rate = F.avg(target)
    more = []
    if offset is not None:
        more.append(F.avg(sigmoid(F.col(logit) + offset)).alias("calibrated"))
    if slope is not None:
        more.append(F.avg(sigmoid(F.col(logit) * slope + shift)).alias("full_calibrated"))
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("n_target"), rate.alias("badrate"), (z * F.sqrt(rate * (1 - rate) / F.count("*"))).alias("ci"), F.avg(sigmoid(F.col(logit))).alias("pred"), *more, F.min(logit).alias("logit_min"), F.max(logit).alias("logit_max"))


def hosmer_lemeshow(table: DataFrame) -> DataFrame:
    """One row over a gain chart table: hl and groups; buckets without variance are left out."""
    e = F.col("pred") * F.col("n")
    var = e * (1 - F.col("pred"))
    return table.agg(F.sum(F.when(var > 0, (F.col("n_target") - e) ** 2 / var)).alias("hl"), F.count("*").alias("groups"))


def hosmer_lemeshow_p(stat: float, groups: int) -> float:
    return chi2_tail(stat, max(groups - 2, 1))


def _no_nulls(df: DataFrame, *columns: str) -> None:
    if df.filter(" OR ".join(f"`{c}` IS NULL" for c in columns)).limit(1).count():
        raise ValueError(f"{' and '.join(columns)} must not hold nulls")


def calibration_offset(df: DataFrame, logit: str, target: str, rounds: int = 50) -> float:
    """b with mean of sigmoid(logit + b) equal to the target rate; NaN for a rate of 0 or 1. Newton steps, one aggregate each."""
    rate = df.agg(F.avg(target)).first()[0]
    if rate is None or rate <= 0 or rate >= 1:
        return math.nan
    h = df.groupBy(F.col(logit).alias("l")).agg(F.count("*").alias("n")).cache()
    low, high, b = -60.0, 60.0, 0.0
    try:
        for _ in range(rounds):
            p = sigmoid(F.col("l") + b)
            got, slope = h.agg(F.sum(F.col("n") * p) / F.sum("n"), F.sum(F.col("n") * p * (1 - p)) / F.sum("n")).first()
            if abs(got - rate) < 1e-13:
                break
            low, high = (b, high) if got < rate else (low, b)
            step = b - (got - rate) / slope if slope > 1e-300 else math.inf
            b = step if low < step < high else (low + high) / 2
    finally:
        h.unpersist()
    return b


def full_calibration(df: DataFrame, logit: str, target: str, rounds: int = 50) -> tuple[float, float]:
    """(k, b) of the unpenalised logistic regression of the target on the logit: Newton steps over a histogram."""
    h = df.groupBy(F.col(logit).alias("l")).agg(F.count("*").alias("n"), F.sum(target).alias("y")).cache()
    k, b = 1.0, 0.0
    try:
        for _ in range(rounds):
            p = sigmoid(F.col("l") * k + b)
            v, r = F.col("n") * p * (1 - p), F.col("y") - F.col("n") * p
            g1, g0, a, c, d = h.agg(F.sum(r * F.col("l")), F.sum(r), F.sum(v * F.col("l") * F.col("l")), F.sum(v * F.col("l")), F.sum(v)).first()
            det = a * d - c * c
            if abs(det) < 1e-300:
                return math.nan, math.nan
            dk, db = (d * g1 - c * g0) / det, (a * g0 - c * g1) / det
            k, b = k + max(-5, min(5, dk)), b + max(-5, min(5, db))
            if abs(dk) + abs(db) < 1e-12:
                break
    finally:
        h.unpersist()
    return k, b


def gain_chart(df: DataFrame, logit: str, target: str, buckets: int = 10) -> tuple[DataFrame, dict]:
    """(table, metrics): the chart with both calibrations, and roc_auc, hl, hl_p, n_buck, offset, coef, intercept."""
    _no_nulls(df, logit, target)
    offset, (k, b) = calibration_offset(df, logit, target), full_calibration(df, logit, target)
    table = gain_chart_table(df, logit, target, buckets, offset=offset, slope=k, shift=b)
    hl = hosmer_lemeshow(table).first()
    last = table.orderBy(F.desc("bucket")).first()
    auc = ranking_metrics(df, target, logit).first()["auc"]
    return table, {"roc_auc": auc, "hl": hl["hl"], "hl_p": hosmer_lemeshow_p(hl["hl"], hl["groups"]), "n_buck": last["n"], "offset": offset, "coef": k, "intercept": b}


def gain_chart_metrics(df: DataFrame, logit: str, target: str, group: str, buckets: int = 10) -> list[dict]:
    """Rounded metrics of each group, each with its own buckets."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]
    out = []
    for name in names:
        m = gain_chart(df.filter(F.col(group).eqNullSafe(F.lit(name))), logit, target, buckets)[1]
        out.append({"group": name, "roc_auc": round(m["roc_auc"], 4) if m["roc_auc"] is not None else None, "hl": round(m["hl"], 1), "offset": round(m["offset"], 4), "coef": round(m["coef"], 4)})
    return out
