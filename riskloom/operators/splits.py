"""Leakage-safe splits, folds and samples: deterministic, ordered by a seeded hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.plans.relational import buckets_of, one_row, running, seeded_order


#: Rows of one hash prefix that may be ordered together.
EDGE_ROWS = 100_000


def hash_rank(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``__rank`` (from 1, in the order of the seeded hash within ``by``) and ``__n``.

    Ranks are made inside (group, hash prefix) and shifted by the prefixes' counts, so no group is
    ordered in one task; prefixes are as many as shuffle partitions, 64 at least.
    """
    by, buckets = list(by), min(65536, buckets or buckets_of(df, 64))
    rows = df.withColumn("__h", seeded_order(seed, key)).withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") % 65536 * buckets)
    rows = rows.withColumn("__b", F.floor(F.col("__b") / 65536).cast("int"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__c"))
    counts = counts.select(*[F.col(c).alias(f"__k_{c}") for c in [*by, "__b"]], (F.sum("__c").over(whole.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(whole).alias("__n"))
    inner = rows.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", key)))
    joined = inner.join(counts, [inner[c].eqNullSafe(counts[f"__k_{c}"]) for c in [*by, "__b"]])
    return joined.withColumn("__rank", F.col("__before") + F.col("__r")).drop("__h", "__b", "__r", "__before", *[f"__k_{c}" for c in [*by, "__b"]])


@dataclass
class DataSplit:
    """A table with a ``part`` column (train, val, test); parts are disjoint by construction."""

    data: DataFrame
    target: str

    def part(self, name: str) -> DataFrame:
        if name not in ("train", "val", "test"):
            raise KeyError(name)
        return self.data.filter(F.col("part") == name)

    train = property(lambda self: self.part("train"))
    val = property(lambda self: self.part("val"))
    test = property(lambda self: self.part("test"))

    def labeled(self) -> DataFrame:
        return self.data

    def items(self) -> list[tuple[str, DataFrame]]:
        present = {r[0] for r in self.data.select("part").distinct().collect()}
        return [(p, self.part(p)) for p in ("train", "val", "test") if p in present]

    def xy(self, part: str, features: Sequence[str]) -> DataFrame:
        return self.part(part).select(*features, self.target)

    def eval_sets(self, parts: Sequence[str] = ("val", "test")) -> dict[str, DataFrame]:
        return {p: d for p, d in self.items() if p in parts}

    def summary(self, date: str | None = None) -> DataFrame:
        dates = [F.min(date).alias("date_min"), F.max(date).alias("date_max")] if date else []
        return self.data.groupBy("part").agg(F.count("*").alias("n"), F.sum(self.target).cast("long").alias("n_target"), F.avg(self.target).alias("target_rate"), *dates)

    def check(self, key: str) -> None:
        """Raise if a key is in more than one part."""
        if self.data.groupBy(key).agg(F.count_distinct("part").alias("n")).filter("n > 1").limit(1).count():
            raise ValueError("parts overlap")


def random_split(df: DataFrame, target: str, key: str, val_size: float = 0.2, test_size: float = 0.0, stratify: bool = True, seed: int = 42) -> DataSplit:
    """Exact shares by the seeded order, within target classes if stratified."""
    ranked = hash_rank(df, key, seed, [target] if stratify else [])
    n_test, n_val = F.bround(F.col("__n") * test_size), F.bround(F.col("__n") * val_size)
    part = F.when(F.col("__rank") <= n_test, "test").when(F.col("__rank") <= n_test + n_val, "val").otherwise("train")
    return DataSplit(ranked.withColumn("part", part).drop("__rank", "__n"), target)


def time_split(df: DataFrame, target: str, date: str, key: str, oot_from: str, oot_to: str | None = None, val_size: float = 0.2, val_mode: str = "random", seed: int = 42) -> DataSplit:
    """Test is out of time; of the rows before, val is drawn by the seeded order within classes, or is the last share by date.

    Rows without a date and rows from ``oot_to`` on are in no part.
    """
    start = F.lit(oot_from).cast("timestamp")
    oot = F.col(date) >= start
    if oot_to:
        oot = oot & (F.col(date) < F.lit(oot_to).cast("timestamp"))
    test, dev = df.filter(oot).withColumn("part", F.lit("test")), df.filter(F.col(date) < start)
    if val_mode == "random":
        ranked = hash_rank(dev, key, seed, [target])
        placed = ranked.withColumn("part", F.when(F.col("__rank") <= F.bround(F.col("__n") * val_size), "val").otherwise("train")).drop("__rank", "__n")
    elif val_mode == "time":
        # the cut's day is found on counts by day; only the rows of that day are ordered
        days = dev.groupBy(F.to_date(date).alias("__d")).agg(F.count("*").alias("__c")).withColumn("__o", F.datediff("__d", F.lit("1970-01-01")))
        days = running(days, [], "__o", {"__upto": F.col("__c")})
        first = F.col("__upto_all") - F.bround(F.col("__upto_all") * val_size)  # rows up to this rank are train
        day = days.filter((F.col("__upto") - F.col("__c") <= first) & (first < F.col("__upto"))).select(F.col("__d").alias("__cut"), (first - (F.col("__upto") - F.col("__c"))).alias("__left"))
        joined = dev.crossJoin(one_row(day)).withColumn("__d", F.to_date(date))
        on = F.coalesce(F.col("__d") == F.col("__cut"), F.lit(False))
        edge = joined.filter(on).withColumn("__r", F.row_number().over(W.partitionBy("__d").orderBy(date, key)))
        edge = edge.withColumn("part", F.when(F.col("__r") > F.col("__left"), "val").otherwise("train")).drop("__r")
        rest = joined.filter(~on).withColumn("part", F.when(F.col("__d") > F.col("__cut"), "val").otherwise("train"))
        placed = edge.unionByName(rest).drop("__d", "__cut", "__left")
    else:
        raise ValueError("val_mode is random or time")
    return DataSplit(placed.unionByName(test), target)


def make_folds(df: DataFrame, target: str, key: str, n_splits: int = 5, stratify: bool = True, test_size: float = 0.2, seed: int = 42, name: str = "fold") -> DataFrame:
    """``df`` with a fold number; ``n_splits`` of 1 or less gives fold 0 as a holdout of ``test_size`` and -1 for the rest."""
    ranked = hash_rank(df, key, seed, [target] if stratify else [])
    fold = (F.col("__rank") - 1) % n_splits if n_splits > 1 else F.when(F.col("__rank") <= F.bround(F.col("__n") * test_size), 0).otherwise(-1)
    return ranked.withColumn(name, fold.cast("int")).drop("__rank", "__n")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows in the seeded order.

    Counts by hash prefix tell the prefix that the n-th row falls on; whole prefixes before it are taken, and
    only the rows of that one are ordered, further by longer prefixes while they are many.
    """
    if n <= 0:
        return df.limit(0)
    rows = df.withColumn("__h", F.coalesce(seeded_order(seed, key), F.lit("0" * 32)))
    taken, left, inside = [], n, rows
    for length in (4, 8, 12):
        part = F.substring("__h", 1, length)
        counts = running(inside.groupBy(F.conv(part, 16, 10).cast("long").alias("__o")).agg(F.count("*").alias("__c")), [], "__o", {"__upto": F.col("__c")})
        edge = counts.filter((F.col("__upto") - F.col("__c") < left) & (F.col("__upto") >= left)).select("__o", "__upto", "__c").first()
        if edge is None:  # all that is left
            return reduce(DataFrame.unionByName, [*taken, inside]).drop("__h")
        at = F.conv(part, 16, 10).cast("long")
        taken.append(inside.filter(at < edge["__o"]))
        left -= edge["__upto"] - edge["__c"]
        inside = inside.filter(at == edge["__o"])
        if edge["__c"] <= EDGE_ROWS:
            break
    first = inside.withColumn("__r", F.row_number().over(W.partitionBy(F.substring("__h", 1, 4)).orderBy("__h", key))).filter(F.col("__r") <= left).drop("__r")
    return reduce(DataFrame.unionByName, [*taken, first]).drop("__h")


def stratified_cap(df: DataFrame, target: str, key: str, max_rows: int, seed: int = 42) -> DataFrame:
    """At most about ``max_rows`` rows with the classes in proportion; all rows if there are no more."""
    ranked = hash_rank(df, key, seed, [target])
    total = ranked.groupBy(target).agg(F.max("__n").alias("c")).agg(F.sum("c").alias("__all"))
    share = F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("__all"))
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("__rank") <= F.bround(F.col("__n") * share)).drop("__rank", "__n", "__all")
