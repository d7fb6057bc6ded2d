"""Plan-building helpers: guarded arithmetic, distributed running sums, unpivoting, seeded order."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one for a local master and an error on a cluster."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='riskloom-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` evaluated once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class TableInFolder:
    """``df`` written to the shared folder as Parquet and read again, until it is deleted: a cut of the lineage that doesn't pile up."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self._path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
        self._files = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        df.write.parquet(self._path.toString())
        self.df = spark.read.schema(df.schema).parquet(self._path.toString())

    def delete(self) -> None:
        self._files.delete(self._path, True)


def safe_div(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or null."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def deviation(x: Column, of: Callable[[Column], Column] = F.stddev_pop) -> Column:
    """A standard deviation that is 0 where all values are equal: the means of Spark's parts can differ in the last digit, so that its own is above 0 by chance."""
    return F.when((F.min(x) == F.max(x)) & of(x).isNotNull(), F.lit(0.0)).otherwise(of(x))


def no_nan(x: Column) -> Column:
    """NaN becomes null: one notion of missing."""
    return F.when(~F.isnan(x), x)


def present(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with NaN turned into null in its float columns."""
    kinds = dict(df.dtypes)
    chosen = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: no_nan(F.col(c)) for c in chosen}) if chosen else df


def seeded_order(seed: int, key: str) -> Column:
    """A hash that orders rows the same in any engine: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def buckets_of(df: DataFrame, least: int) -> int:
    """Into how many ranges or hash prefixes a table is cut where one task each orders them: as many as it is shuffled into."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running(df: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """Add for each name the sum of its column over the rows of the group up to and including this value of ``order``, and the group's whole sum as ``<name>_all``.

    A group is cut into ranges of ``order`` at approximate quantiles, about as many as there are
    shuffle partitions; sums run inside a range and over the few range totals, so no task sorts a
    whole group. A value finds its range in two steps of about the root of their number. Rows should
    be distinct in (by, order).
    """
    by = list(by)
    fan = math.ceil(math.sqrt(buckets or buckets_of(df, 32)))
    cuts = [k / fan**2 for k in range(1, fan**2)]
    edges = df.agg(F.percentile_approx(F.col(order).cast("double"), cuts, max(2000, 2 * fan**2)).alias("__edges"))
    below = lambda part: F.size(F.filter(part, lambda e: e < F.col(order)))
    outer = F.coalesce(F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda i: F.get("__edges", i * fan - 1)), F.array().cast("array<double>")) if fan > 1 else F.array().cast("array<double>")
    cut = df.crossJoin(F.broadcast(edges.withColumn("__outer", outer))).withColumn("__range", below(F.col("__outer")))
    cut = cut.withColumn("__range", F.col("__range") * fan + below(F.slice("__edges", F.col("__range") * fan + 1, F.lit(fan - 1)))).drop("__edges", "__outer") if fan > 1 else cut.drop("__edges", "__outer")
    valued = cut.withColumns({f"__v_{k}": v for k, v in sums.items()})
    totals = valued.groupBy(*by, "__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = whole.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__k_{c}") for c in [*by, "__range"]], *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums], *[F.sum(f"__t_{k}").over(whole).alias(f"{k}_all") for k in sums])
    inside = W.partitionBy(*by, "__range").orderBy(order)
    inner = valued.withColumns({k: F.sum(f"__v_{k}").over(inside) for k in sums})
    same = [inner[c].eqNullSafe(totals[f"__k_{c}"]) for c in [*by, "__range"]]
    joined = inner.join(totals, same)
    joined = joined.withColumns({k: F.col(k) + F.col(f"__b_{k}") for k in sums})
    return joined.drop("__range", *[f"__k_{c}" for c in [*by, "__range"]], *[f"__b_{k}" for k in sums], *[f"__v_{k}" for k in sums])


def quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), name: str = "quantiles", weight: str | None = None) -> DataFrame:
    """Keys and an array of the exact quantiles of ``column``, interpolated between neighbours, one for each share; a row counts ``weight`` times.

    Taken from running counts over the histogram of distinct values: a value answers the shares whose
    ranks fall on it, and only these answers are gathered. Groups without a value have no row.
    """
    by = list(by)
    rows = df.select(*by, no_nan(F.col(column).cast("double")).alias("__x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")).filter("__x IS NOT NULL")
    h = rows.groupBy(*by, "__x").agg(F.sum("__w").alias("__n"))
    c = running(h, by, "__x", {"__c": F.col("__n")})
    at = lambda q: q * (F.col("__c_all") - 1)
    holds = lambda rank: (rank >= F.col("__c") - F.col("__n")) & (rank < F.col("__c"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(shares)])
    hits = F.filter(wanted, lambda w: holds(F.floor(at(w["q"]))) | holds(F.ceil(at(w["q"]))))
    rows = c.select(*by, "__x", "__c", "__n", "__c_all", F.explode(hits).alias("__w"))
    rank = at(F.col("__w.q"))
    pick = lambda r: F.max(F.when(holds(r), F.col("__x")))
    found = rows.groupBy(*by, F.col("__w.k").alias("__k")).agg(pick(F.floor(rank)).alias("__lo"), pick(F.ceil(rank)).alias("__hi"), F.max(rank - F.floor(rank)).alias("__part"))
    value = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__part")
    return found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("__k", value.alias("v")))).alias("__a")).select(*by, F.transform("__a", lambda a: a["v"]).alias(name))


def one_row(df: DataFrame) -> DataFrame:
    """A table of one row or none, with a row of nulls instead of none, to be broadcast."""
    return F.broadcast(df.sparkSession.range(1).select().join(df, F.lit(True), "left"))


def long_form(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value", cast: str = "double") -> DataFrame:
    """One row per (row, column): ``keep`` with the column's name and its value."""
    return df.select(*keep, *[F.col(c).cast(cast).alias(c) for c in columns]).unpivot(list(keep), list(columns), name, value)
