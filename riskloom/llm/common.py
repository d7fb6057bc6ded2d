"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, whatever store the path points to."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if it isn't installed there."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='riskloom-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once and cut its lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(name: str):
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: A table of at most this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def joined_to(large: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join a large table with a side whose size is measured first.

    A side of up to BROADCAST_BYTES is broadcast, so that the large table's texts stay where they
    lie; beyond it both sides are shuffled. ``side`` should be cut already, as it is read twice.
    """
    return large.join(F.broadcast(side) if small(side) else side, keys, how)


def small(side: DataFrame) -> bool:
    """Whether a table, cut already, has at most BROADCAST_BYTES."""
    width = F.length(F.to_json(F.struct(*side.columns)))
    return (side.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


#: A key with more rows than this is dealt out over several tasks.
HOT_ROWS = 20_000


def spread_to(large: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", rows: str = "n", hot_rows: int = HOT_ROWS, salt: Column | None = None) -> DataFrame:
    """Join a large table with a side of one row per key that counts the key's ``rows`` in the large one.

    Keys of more than ``hot_rows`` rows are dealt out: their rows get a salt each, of as many as their
    count asks for, and the side's row is repeated for every salt. The hot keys, at most one in
    ``hot_rows`` rows, are told to the large table by a measured broadcast. ``side`` should be cut already.
    ``salt`` is what rows are dealt by; by default all their columns, which doesn't tell equal rows apart.
    """
    salts = F.ceil(F.col(rows) / hot_rows)
    hot = side.filter(F.col(rows) > hot_rows).select(*keys, salts.alias("salts_"))
    dealt = joined_to(large, hot, keys, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*large.columns) if salt is None else salt, "salts_"), F.lit(0)).cast("long")).drop("salts_")
    repeated = side.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)).cast("long") - 1)))
    return dealt.join(repeated, [*keys, "salt_"], how).drop("salt_")
