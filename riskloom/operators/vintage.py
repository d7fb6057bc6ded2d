"""Cumulative recovery (vintage) curves as one plan: grid, daily sums, first payments, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.plans.relational import quantiles as exact_quantiles

MILESTONES = (30, 90, 180, 365, 730, 1095)


def _curves(df: DataFrame, group: str | None, own_base: bool, client: str, days: str, amount: str, balance: str, retro: str, horizon: int, step: int, processed: str | None, population: DataFrame | None) -> DataFrame:
    """Curves by ``group``; base and horizon of the whole table, or of each group with ``own_base``."""
    base_key = [group] if group and own_base else []
    limit = F.lit(horizon)
    if processed:
        limit = F.greatest(F.lit(0), F.least(limit, F.datediff(F.lit(processed).cast("date"), F.max(retro))))
    horizons = df.groupBy(*base_key).agg(F.coalesce(limit, F.lit(horizon)).cast("long").alias("h")) if base_key else df.agg(F.coalesce(limit, F.lit(horizon)).cast("long").alias("h"))
    clients = (population if population is not None else df).filter(F.col(client).isNotNull()).groupBy(*base_key, client).agg(F.coalesce(F.min(balance), F.lit(0.0)).alias("b"))
    base = clients.groupBy(*base_key).agg(F.count("*").alias("n_total"), F.sum("b").alias("total_balance"))
    frame = base.join(horizons, base_key) if base_key else base.crossJoin(F.broadcast(horizons))
    if group and not own_base:
        names = df.filter(F.col(days).isNotNull() & F.col(amount).isNotNull()).select(group).distinct()
        frame = names.crossJoin(F.broadcast(frame))  # one row
    keys = [group] if group else []
    grid = frame.select("*", F.explode(F.expr(f"sequence(0L, h, {step}L)")).alias("day"))
    events = df.filter(F.col(days).isNotNull() & F.col(amount).isNotNull() & (F.col(days) >= 0))
    events = events.join(horizons, base_key) if base_key else events.crossJoin(F.broadcast(horizons))
    events = events.filter(F.col(days) <= F.col("h")).withColumn("day", (F.col(days) - F.col(days) % step).cast("long"))
    daily = events.groupBy(*keys, "day").agg(F.count("*").alias("c"), F.sum(amount).alias("s"))
    first = events.groupBy(*keys, client).agg(F.min("day").alias("day")).groupBy(*keys, "day").agg(F.count(client).alias("f"))
    joined = grid.join(daily, [*keys, "day"], "left").join(first, [*keys, "day"], "left")
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    out = joined.select(*keys, "day", "n_total", "total_balance", total("c").alias("cum_tx_cnt"), total("s").cast("double").alias("cum_tx_sum"), total("f").alias("cum_clients_with_tx"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("cum_share_of_balance", share("cum_tx_sum", "total_balance")).withColumn("cum_share_clients", share("cum_clients_with_tx", "n_total"))


def vintage(df: DataFrame, client: str, days: str, amount: str, balance: str, retro: str, horizon: int = 365, step: int = 1, processed: str | None = None, population: DataFrame | None = None, sample: str = "all") -> DataFrame:
    """One curve of the whole table. The horizon is cut to what every client has had time for by ``processed``."""
    out = _curves(df, None, False, client, days, amount, balance, retro, horizon, step, processed, population)
    return out.select(F.lit(sample).alias("sample"), *out.columns)


def _leading(samples: DataFrame, by: str, top_k: int | None) -> DataFrame:
    """The samples to keep: all, or the ``top_k`` largest, ties by name."""
    return (samples if top_k is None else samples.orderBy(F.desc(by), "sample").limit(top_k)).select("sample")


def vintage_by_type(df: DataFrame, tx_type: str, client: str, days: str, amount: str, balance: str, retro: str, types: Sequence[str] | None = None, top_k: int | None = None, min_tx: int = 0, abs_amount: bool = False, **more) -> DataFrame:
    """Curves by transaction type over one common base and horizon. ``top_k`` ranks types by absolute turnover, ties by name."""
    rows = df.withColumn("sample", F.coalesce(F.col(tx_type).cast("string"), F.lit("NA")))
    if abs_amount:
        rows = rows.withColumn(amount, F.abs(amount))
    out = _curves(rows, "sample", False, client, days, amount, balance, retro, more.pop("horizon", 365), more.pop("step", 1), more.pop("processed", None), more.pop("population", None))
    if types is not None:
        out = out.filter(F.col("sample").isin(list(types)))
    if top_k is not None or min_tx:
        paid = rows.filter(F.col(days).isNotNull() & F.col(amount).isNotNull()).groupBy("sample").agg(F.abs(F.sum(amount)).alias("turnover"), F.count("*").alias("n_tx")).filter(F.col("n_tx") >= min_tx)
        out = out.join(_leading(paid, "turnover", top_k), "sample", "left_semi")
    return out


def vintage_by_segment(df: DataFrame, segment: str, client: str, days: str, amount: str, balance: str, retro: str, segments: Sequence[str] | None = None, top_k: int | None = None, min_contracts: int = 0, population: DataFrame | None = None, **more) -> DataFrame:
    """Curves by segment, each over its own clients and horizon. ``top_k`` ranks segments by clients, ties by name."""
    named = lambda t: t.withColumn("sample", F.coalesce(F.col(segment).cast("string"), F.lit("NA")))
    rows = named(df)
    out = _curves(rows, "sample", True, client, days, amount, balance, retro, more.pop("horizon", 365), more.pop("step", 1), more.pop("processed", None), named(population) if population is not None else None)
    if segments is not None:
        out = out.filter(F.col("sample").isin(list(segments)))
    if top_k is not None or min_contracts:
        sizes = rows.groupBy("sample").agg(F.count_distinct(client).alias("n")).filter(F.col("n") >= min_contracts)
        out = out.join(_leading(sizes, "n", top_k), "sample", "left_semi")
    return out


def at_milestones(curves: DataFrame, milestones: Sequence[int] = MILESTONES) -> DataFrame:
    return curves.filter(F.col("day").isin([int(m) for m in milestones]))


def transaction_profile(df: DataFrame, client: str, amount: str, days: str, tx_date: str, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), top_n: int = 10) -> dict[str, DataFrame]:
    """Small tables about a transaction table: overview, nulls, quantiles, per client, signs, top clients, months, days."""
    tx = df.filter(F.col(amount).isNotNull())
    per = tx.groupBy(client).agg(F.count("*").alias("n_tx"), F.sum(amount).alias("turnover"), F.avg(amount).alias("mean_amount"))
    return {
        "overview": df.agg(F.count("*").alias("n_rows"), F.count_distinct(client).alias("n_clients"), F.count(amount).alias("n_tx"), F.sum(amount).alias("turnover"), F.min(tx_date).alias("first_tx"), F.max(tx_date).alias("last_tx")),
        "nulls": df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "n_missing").withColumn("column", F.col("column")),
        "quantiles": exact_quantiles(tx, amount, quantiles, name="v").select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("k") + 1).alias("q"), "value"),
        "per_client": per.agg(F.count("*").alias("n_clients"), F.avg("n_tx").alias("mean_n_tx"), F.max("n_tx").alias("max_n_tx"), F.avg("turnover").alias("mean_turnover"), F.max("turnover").alias("max_turnover")),
        "signs": tx.groupBy(F.signum(amount).cast("int").alias("sign")).agg(F.count("*").alias("n_tx"), F.sum(amount).alias("turnover")),
        "top_clients": per.orderBy(F.desc("turnover"), client).limit(top_n),
        "by_month": tx.groupBy(F.date_trunc("month", tx_date).alias("month")).agg(F.count("*").alias("n_tx"), F.sum(amount).alias("turnover")),
        "by_day": tx.filter(F.col(days).isNotNull()).groupBy(days).agg(F.count("*").alias("n_tx"), F.sum(amount).alias("turnover")),
    }
