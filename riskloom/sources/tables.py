"""Sources and sinks: Parquet and CSV tables, and the observation and transaction views used by the queries."""

from __future__ import annotations

import codecs
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; give a schema where the data is large, as inference reads it twice."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for small result tables: one UTF-8 file with a byte order mark, rows streamed to the driver."""
    if not single_file:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    import csv

    with open(path, "wb") as f:
        f.write(codecs.BOM_UTF8)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())


def contracts_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts (orders) left joined with their transactions (lineitem)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select(
        F.col("o_orderkey").alias("client_id"), F.col("o_orderdate").alias("retro_dt"), F.col("o_totalprice").alias("balance"), F.col("o_orderpriority").alias("segment"),
        F.col("l_shipdate").alias("tx_dt"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("tx_days"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("tx_type"),
    )


CONTRACTS_TX_SQL = """contracts_tx AS (SELECT o_orderkey AS client_id, o_orderdate AS retro_dt, o_totalprice AS balance, o_orderpriority AS segment,
 l_shipdate AS tx_dt, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS tx_days, l_extendedprice AS amount, l_returnflag AS tx_type
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with a binary target, a date, a segment, features and a score; key row_id."""
    o, c, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").cast("double").alias("n_lines"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(per, o.o_orderkey == per.l_orderkey, "left")
    score = F.round(1 / (1 + F.exp(-(F.col("o_totalprice") / 200000.0 - 1.0))), 6)
    return j.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("target"), F.col("o_orderdate").alias("date"), F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("acctbal"), "quantity", "discount", "tax", "n_lines",
        (2 * F.col("o_totalprice") + F.pmod(F.col("o_orderkey"), F.lit(7))).alias("price_copy"), F.lit(1.0).alias("constant"), F.lit(None).cast("double").alias("empty"),
        F.when(F.col("o_orderkey") % 100 == 0, 1.0).otherwise(0.0).alias("mostly_zero"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 10 == 0, "nan").otherwise((F.col("o_orderkey") % 5).cast("string")).alias("code"), score.alias("score"),
    )


OBSERVATIONS_SQL = """per_order AS (SELECT l_orderkey, round(sum(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax, CAST(count(*) AS DOUBLE) AS n_lines FROM lineitem GROUP BY l_orderkey),
obs AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, o_orderdate AS date, c_mktsegment AS segment, o_totalprice AS price, c_acctbal AS acctbal, quantity, discount, tax, n_lines,
 CAST(2 * o_totalprice + o_orderkey % 7 AS DOUBLE) AS price_copy, CAST(1 AS DOUBLE) AS constant, CAST(NULL AS DOUBLE) AS empty, CAST(CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mostly_zero, o_orderpriority AS priority,
 CASE WHEN o_orderkey % 10 = 0 THEN 'nan' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS code, round(CAST(1 AS DOUBLE) / (1 + exp(-(o_totalprice / CAST(200000 AS DOUBLE) - 1))), 6) AS score
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN per_order ON o_orderkey = l_orderkey)"""

NUMERIC: Sequence[str] = ("price", "acctbal", "quantity", "discount", "tax", "n_lines", "price_copy", "constant", "empty", "mostly_zero")
