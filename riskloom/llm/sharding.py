"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash within their source and get the fractional rank
(rank - 0.5) / rows of the source. Sorted by fractional rank, every stretch of rows has the
sources in the proportions of the whole, so equal cuts give shards that match the mixture and
whose row counts differ by one at most (law ``rows``).

No source is gathered in one task: ranks are made within (source, hash bucket) and shifted by the
rows of the buckets before; so is the position in the global order. The number of buckets follows the
number of rows, so that a bucket has about ``bucket_rows`` of them, and their counts are summed in
groups of about the root of their number, so no task orders all buckets either. Buckets are ranges of
the md5 and of the fraction, so the result doesn't depend on their number.

Defined results: a null text has size 1 and the checksum of the empty text; null sources and ids
form a source or tie like any value; rows alike in all columns are told apart by an arbitrary but
complete order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import cut


def _numbered(df: DataFrame, strata: list[str], bucket: str, order: list, name: str, width: int) -> DataFrame:
    """Row number from 1 within ``strata`` in the order of bucket, then ``order``, and the stratum's rows as n_<name>.

    The rows before a bucket are those of the groups of ``width`` buckets before its own and those of
    the buckets before it in its group.
    """
    n = F.col("bucket_n")
    counts = cut(df.groupBy(*strata, bucket).agg(F.count("*").alias("bucket_n"))).withColumn("bucket_group", F.floor(F.col(bucket) / width))
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    groups = counts.groupBy(*strata, "bucket_group").agg(F.sum("bucket_n").alias("group_n"))
    groups = groups.select(*strata, "bucket_group", (F.sum("group_n").over(whole.orderBy("bucket_group")) - F.col("group_n")).alias("groups_before"), F.sum("group_n").over(whole).alias(f"n_{name}"))
    inside = counts.withColumn("rows_before", F.sum(n).over(W.partitionBy(*strata, "bucket_group").orderBy(bucket)) - n)
    before = inside.join(groups, [*strata, "bucket_group"]).select(*[F.col(c).alias(f"k_{c}") for c in [*strata, bucket]], (F.col("rows_before") + F.col("groups_before")).alias("rows_before"), f"n_{name}")
    inner = df.withColumn("rank_in_bucket", F.row_number().over(W.partitionBy(*strata, bucket).orderBy(*order)))
    same = [inner[c] == before[f"k_{c}"] for c in [*strata, bucket]]
    joined = inner.join(before, same, "inner")
    return joined.withColumn(name, F.col("rows_before") + F.col("rank_in_bucket")).drop("rows_before", "rank_in_bucket", *[f"k_{c}" for c in [*strata, bucket]])


def _seeded(seed: int, value: Column) -> Column:
    """md5 of seed and value: an order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(value.cast("string"), F.lit(""))))


def interleaved_shards(df: DataFrame, keep: list[str], id_col: str, stratum_col: str, shards: int = 16, seed: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """``keep`` columns of ``df`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    rows = cut(df.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum")))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    width = math.isqrt(buckets) + 1
    leading = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    shuffled = rows.withColumn("h", _seeded(seed, F.col("id"))).withColumn("h_bucket", F.shiftright(leading * buckets, 32))
    ranked = _numbered(shuffled, ["stratum"], "h_bucket", [F.col("h"), F.col("id")], "rank", width)
    placed = ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("n_rank"))
    placed = cut(placed.select(*[c for c in rows.columns if c.startswith("keep_")], "id", "stratum", "h", "fraction"))
    placed = placed.withColumn("f_bucket", F.floor(F.col("fraction") * buckets))
    ordered = _numbered(placed, [], "f_bucket", [F.col("fraction"), _seeded(seed + 1, F.col("stratum")), F.col("stratum"), F.col("h"), F.col("id")], "place", width)
    at = F.col("place") - 1
    shard = F.expr(f"CAST((place * {shards} - 1) DIV {max(1, total)} AS INT)")
    first = F.expr(f"(CAST((place * {shards} - 1) DIV {max(1, total)} AS BIGINT) * {total}) DIV {shards}")
    return ordered.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], shard.alias("shard"), (at - first).cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Place of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    Only ids, sources, sizes and checksums are shuffled; the texts stay where they lie, and a
    writer joins them back by doc_id or writes by ``shard``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleaved_shards(narrow, ["doc_id", "source", "size", "text_crc32"], "doc_id", "source", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
