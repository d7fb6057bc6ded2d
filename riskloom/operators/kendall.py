"""Kendall's rank correlation (tau-b) of many pairs of columns, without comparing rows with each other.

For each pair of columns the distinct pairs of values are counted. Both columns are cut into ranges at approximate
quantiles, values that are cuts being ranges of their own. A discordant pair of rows lies either in different
ranges of both columns, which the counts of the cells tell; or in one range of the first column; or in one
range of the second and different ones of the first. The last two kinds are inversions inside a range, counted by
merging in its task. No task holds more than one range, and no row meets all others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.plans.relational import buckets_of, one_row

#: At most so many ranges of a column; the cells of a pair are at most four times its square.
MOST_RANGES = 256


def inversions(b: np.ndarray, w: np.ndarray) -> float:
    """Weight of pairs of which the earlier is the greater, each pair weighing the product of its weights: bottom-up merging, all blocks of a width at once."""
    n, total = len(b), 0.0
    place = np.arange(n)
    for k in range(max(0, n - 1).bit_length()):
        block, right = place >> (k + 1), (place >> k) & 1
        order = np.lexsort((right, b, block))
        own, side, weight = block[order], right[order], w[order]
        left = np.where(side == 0, weight, 0.0)
        upto = np.cumsum(left)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(first, n))
        start = np.repeat(upto[first] - left[first], sizes)
        whole = np.repeat(np.add.reduceat(left, first), sizes)
        total += float((weight * (whole - (upto - start)))[side == 1].sum())
    return total


def apart(cells: np.ndarray) -> float:
    """Weight of pairs of cells (first range, second range) of which one is lower in the first and higher in the second."""
    above = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1] - cells  # higher in the second
    before = np.cumsum(above, axis=0) - above  # and lower in the first
    return float((cells * before).sum())


def kendall_matrix(x: DataFrame, features: Sequence[str], ranges: int | None = None) -> DataFrame:
    """(a, b, corr) of each pair a before b of the columns (doubles), over the rows where both are present; null where one is constant."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    if not pairs:
        return x.sparkSession.createDataFrame([], "a string, b string, corr double")
    many = min(MOST_RANGES, ranges or buckets_of(x, 32))
    cuts = F.array(*[F.lit(k / many) for k in range(1, many)]) if many > 1 else F.array(F.lit(0.5))
    edges = x.agg(F.array(*[F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(c, cuts, max(2000, 20 * many)), F.array().cast("array<double>")))) for c in features]).alias("edges"))
    at = {f: k for k, f in enumerate(features)}
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(at[a]).alias("i"), F.lit(at[b]).alias("j")) for a, b in pairs])
    long = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(a).alias("u"), F.col(b).alias("v")) for k, (a, b) in enumerate(pairs)])).alias("t")).select("t.*")
    counts = long.filter("u IS NOT NULL AND v IS NOT NULL").groupBy("k", "u", "v").agg(F.count("*").cast("double").alias("n"))

    def range_of(side: str, value: str) -> Column:
        own = F.get("edges", F.get(names, F.col("k"))[side])
        return 2 * F.size(F.filter(own, lambda e: e < F.col(value))) + F.array_contains(own, F.col(value)).cast("int")

    placed = counts.crossJoin(one_row(edges)).select("k", "u", "v", "n", range_of("i", "u").alias("p"), range_of("j", "v").alias("q")).persist()

    def inside(by: str, first: str, second: str) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            a, b, w = (table.column(c).to_numpy() for c in (first, second, "n"))
            order = np.lexsort((b, a))
            return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()), "d": [inversions(b[order], w[order])]})

        return placed.filter(F.col(by) % 2 == 0).groupBy("k", by).applyInArrow(run, "k int, d double")

    def across(table: pa.Table) -> pa.Table:
        p, q, w = (table.column(c).to_numpy() for c in ("p", "q", "n"))
        cells = np.zeros((p.max() + 1, q.max() + 1))
        np.add.at(cells, (p, q), w)
        return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()), "d": [apart(cells)]})

    grid = placed.groupBy("k", "p", "q").agg(F.sum("n").alias("n")).groupBy("k").applyInArrow(across, "k int, d double")
    discordant = grid.union(inside("p", "u", "v")).union(inside("q", "p", "v")).groupBy("k").agg(F.sum("d").alias("d"))
    two = lambda n: F.sum(n * (n - 1) / 2)
    ties = lambda value, name: placed.groupBy("k", value).agg(F.sum("n").alias("n")).groupBy("k").agg(two(F.col("n")).alias(name))
    whole = placed.groupBy("k").agg(F.sum("n").alias("n"), two(F.col("n")).alias("both"))
    joined = whole.join(ties("u", "tu"), "k").join(ties("v", "tv"), "k").join(discordant, "k", "left")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    spread = F.sqrt((n0 - F.col("tu")) * (n0 - F.col("tv")))
    tau = F.when(spread > 0, (n0 - F.col("tu") - F.col("tv") + F.col("both") - 2 * F.coalesce("d", F.lit(0.0))) / spread)
    known = x.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return known.join(joined.select("k", tau.alias("corr")), "k", "left").select("a", "b", "corr")
