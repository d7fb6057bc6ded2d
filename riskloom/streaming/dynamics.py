"""The append-only parts of the batch operators as streams: target dynamics by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_target_dynamics(stream: DataFrame, time: str, target, window: str = "1 day", lateness: str = "2 days", segment: str | None = None) -> DataFrame:
    """n_total, n_positive and rate by event-time window (and segment); windows are final once the watermark has passed."""
    keys = [F.window(time, window).alias("w"), *([F.coalesce(F.col(segment).cast("string"), F.lit("NaN")).alias("segment")] if segment else [])]
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("__y", target if not isinstance(target, str) else F.col(target)).filter(F.col("__y").isNotNull()).withWatermark(time, lateness)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_total"), F.sum(F.col("__y").cast("long")).alias("n_positive"))
    return out.select(F.col("w.start").alias("period"), *(["segment"] if segment else []), "n_total", "n_positive", (F.col("n_positive") / F.col("n_total")).alias("rate"))
