"""Synthetic demo tables, made where they are used.

Random numbers are bits of the md5 of seed, name and row number, so the tables are the same on any
number of partitions and in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEMO_DOMAINS = {
    "application": ["app_amount", "app_term", "app_age", "app_income", "app_region"],
    "bureau": ["bureau_score", "bureau_open_cnt", "bureau_overdue_sum", "bureau_inquiries", "bureau_legal_flg"],
    "payments": ["pay_cnt_3m", "pay_sum_3m", "pay_days_since", "pay_share"],
    "transactions": ["trx_cnt", "trx_sum", "trx_mean", "trx_channels"],
}


def _poisson(mean: float, u: Column, most: int = 20) -> Column:
    """A Poisson draw from a uniform one, by the inverse of the distribution function."""
    p, acc = math.exp(-mean), 0.0
    out: Column | None = None
    for k in range(most):
        acc += p
        out = F.when(u < acc, k) if out is None else out.when(u < acc, k)
        p *= mean / (k + 1)
    return out.otherwise(most)


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number from 0 to 1 by 32 bits of the md5 of seed, name and the row's keys."""
    return _bits(seed, name, keys, 1) / 4294967296.0


def normal(seed: int, name: str, *keys: str) -> Column:
    """A standard normal number by two times 32 bits (Box and Muller)."""
    u = (_bits(seed, name, keys, 1) + 0.5) / 4294967296.0
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * (_bits(seed, name, keys, 9) / 4294967296.0))


def _bits(seed: int, name: str, keys: tuple[str, ...], first: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("double")


def demo_observations(spark: SparkSession, n: int = 20_000, seed: int = 42) -> DataFrame:
    """Client and date rows with 18 features in four domains and a binary target."""
    u, z = (lambda name: uniform(seed, name, "client_id")), (lambda name: normal(seed, name, "client_id"))
    df = spark.range(n).select(F.col("id").alias("client_id"))
    df = df.withColumns({"risk": z("risk"), "u_seg": u("segment"), "u_bureau": u("bureau"), "u_legal": u("legal")})
    df = df.withColumn("report_date", F.timestamp_add("DAY", F.floor(u("date") * 540).cast("int"), F.expr("timestamp'2023-01-01'")))
    df = df.withColumn("segment", F.when(F.col("u_seg") < 0.5, "early").when(F.col("u_seg") < 0.8, "middle").otherwise("late"))
    bureau, late = F.col("u_bureau") >= 0.1, F.col("report_date") >= F.lit("2023-07-01").cast("timestamp")
    when = lambda ok, x: F.when(ok, x)
    risk = F.col("risk")
    df = df.withColumns({
        "app_amount": F.exp(z("amount") * 0.6 + 10), "app_term": (F.floor(u("term") * 5) * 12 + 12).cast("double"), "app_age": F.greatest(z("age") * 11 + 41, F.lit(18.0)), "app_income": F.exp(z("income") * 0.5 + 10.5 - risk * 0.2), "app_region": F.concat(F.lit("r"), F.floor(u("region") * 8).cast("string")),
        "bureau_score": when(bureau, 600 - risk * 60 + z("score") * 40), "bureau_open_cnt": when(bureau, _poisson(2.5, u("open")).cast("double")), "bureau_overdue_sum": when(bureau, F.greatest(F.lit(0.0), risk * 3000 + z("overdue") * 2000)), "bureau_inquiries": when(bureau, _poisson(1.5, u("inquiries")).cast("double")), "bureau_legal_flg": when(F.col("u_legal") < 0.01, F.lit(1.0)),
        "pay_cnt_3m": _poisson(2.0, u("pay_cnt")).cast("double"), "pay_sum_3m": F.greatest(F.lit(0.0), 5000 - risk * 2500 + z("pay_sum") * 2000), "pay_days_since": F.floor(u("pay_days") * 120 + risk * 20).cast("double"), "pay_share": u("pay_share"),
        "trx_cnt": when(late, _poisson(6.0, u("trx_cnt"), 30).cast("double")), "trx_sum": when(late, F.exp(z("trx_sum") * 0.8 + 8)), "trx_mean": when(late, F.exp(z("trx_mean") * 0.5 + 6)), "trx_channels": when(late, F.concat(F.lit("c"), F.floor(u("channels") * 4).cast("string"))),
    })
    target = (u("target") < 1 / (1 + F.exp(-(risk - 1.2 + F.when(F.col("segment") == "late", 0.5).otherwise(0.0))))).cast("int")
    return df.withColumn("target", target).select("client_id", "report_date", "segment", "target", *[f for fs in DEMO_DOMAINS.values() for f in fs])


def demo_transactions(spark: SparkSession, n_contracts: int = 6_000, seed: int = 42, processed: str = "2025-01-01") -> DataFrame:
    """Contracts left joined with their payments up to ``processed``; contracts without one keep a row."""
    u, v = (lambda name: uniform(seed, name, "contract_id")), (lambda name: uniform(seed, name, "contract_id", "k"))
    day = lambda x, days: F.floor(x * days).cast("int")
    c = spark.range(n_contracts).select(F.col("id").alias("contract_id"))
    c = c.select("contract_id", F.concat(F.lit("product_"), F.floor(u("product") * 3).cast("string")).alias("product"), F.timestamp_add("DAY", day(u("start"), 600), F.expr("timestamp'2023-01-01'")).alias("start_date"), F.round(F.exp(normal(seed, "balance", "contract_id") * 0.7 + 9.5), 2).alias("balance"), (u("flag") < 0.3).cast("int").alias("flag"), _poisson(2.5, u("payments")).alias("n_tx"))
    tx = c.filter("n_tx > 0").select("contract_id", "start_date", "balance", F.explode(F.sequence(F.lit(1), F.col("n_tx"))).alias("k"))
    amount = F.round(F.col("balance") * v("amount") * 0.2 * F.when(v("sign") < 0.03, -1).otherwise(1), 2)
    tx = tx.select("contract_id", F.timestamp_add("DAY", day(v("day"), 500), F.col("start_date")).alias("tx_date"), amount.alias("tx_amount"), F.when(v("type") < 0.7, "voluntary").otherwise("court").alias("tx_type"), F.concat(F.lit("channel_"), F.floor(v("channel") * 4).cast("string")).alias("tx_channel"))
    return c.drop("n_tx").join(tx.filter(F.col("tx_date") <= F.lit(processed).cast("timestamp")), "contract_id", "left")
