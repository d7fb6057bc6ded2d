"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks. In a block every dimension has a sorted list of its components, made
once and used for all queries. A query reads each list from its favourable end down to some depth;
every vector met is scored in full. A vector met nowhere has, in each dimension, no better component
than the one where reading stopped, so the sum of these, weighted by the query, bounds all vectors
that were not met; dimensions that weren't read are bounded by the top of their list or, together,
by Cauchy and Schwarz. Reading stops where the bound cannot beat (nor tie with) the k-th best score.

The k-th best score is carried along: one block is searched first, and all others start from its
k-th scores. With that threshold the depths are chosen at once: of all depths whose bound stays
below it those that promise the fewest vectors to score, by a price per vector that is the same for
all dimensions, so that lists which tell much are read deeper. Where no depths do, as with vectors
that are spread evenly in many dimensions, a query meets the whole block.

Both sides are dealt in blocks, so no task holds all queries or all vectors; a task holds one block
of vectors and streams queries past it.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; vectors of different lengths are never compared; repeated rows each count;
ties go to the smaller id; fewer candidates than k give all of them; other columns are ignored.
Products are exact where they fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import cut

#: Scores that a task works out at once.
SCORES = 1 << 22

LEAST = np.iinfo("i8").min


def quantised(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of each component, of the vectors that can take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("d")).filter(F.col("vec_id").isNotNull() & F.col("d").isNotNull() & F.forall("d", finite))
    return rows.select("vec_id", F.transform("d", lambda x: F.floor(x * scale)).alias("v")).withColumn("dim", F.size("v"))


class Block:
    """A block of vectors with the sorted list of every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n = len(ids)
        self.lists = np.argsort(x, axis=0, kind="stable").astype("i4")
        self.peak = float(np.abs(x).max(initial=0))
        self.norm = float(np.sqrt((x.astype("f8") ** 2).sum(axis=1)).max(initial=0))
        #: depths at which reading may stop, and the components met there from either end of each list
        self.depths = np.unique(np.minimum([0, *(16 << k for k in range(max(1, n.bit_length())))], n))
        at = np.minimum(self.depths[:-1], n - 1)
        down = np.take_along_axis(x, self.lists[n - 1 - at], 0)
        up = np.take_along_axis(x, self.lists[at], 0)
        self.down, self.up = down.astype("f8"), up.astype("f8")  # (depth, dimension)
        self.scored = 0

    def _bound(self, q: np.ndarray, adds: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The best score that a vector not met can have; dimensions that aren't read together by Cauchy and Schwarz, if that is less."""
        part = np.take_along_axis(adds, level[:, None, :], 1)[:, 0]
        unread = level == 0
        rest = np.minimum((part * unread).sum(axis=1), np.sqrt((q * q * unread).sum(axis=1)) * self.norm)
        return (part * ~unread).sum(axis=1) + rest

    def stops(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For every query and dimension the depth to read, so that nothing unread reaches ``floor``; the whole list where no depths do."""
        n, q = len(self.ids), queries.astype("f8")
        # what a dimension adds to the bound when its list is read to each depth
        adds = np.where(q[:, None, :] > 0, q[:, None, :] * self.down, q[:, None, :] * self.up)
        cost = self.depths[:-1].astype("f8")
        low, high = np.zeros(len(q)), np.full(len(q), 1.0)
        limit = floor.astype("f8")

        def chosen(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            level = np.argmin(adds + price[:, None, None] * cost[None, :, None], axis=1)
            return level, self._bound(q, adds, level)

        level, bound = chosen(low)
        whole = bound >= limit * (1 - 1e-9 * np.sign(limit)) - 1e-6  # even the deepest reading leaves room
        high *= max(1.0, self.peak) * np.abs(q).max(initial=1.0)
        for _ in range(24):
            price = np.sqrt(np.maximum(low, 1e-6) * high)
            tried, bound = chosen(price)
            below = bound < limit * (1 - 1e-9 * np.sign(limit)) - 1e-6
            level = np.where(below[:, None], tried, level)
            low, high = np.where(below, price, low), np.where(below, high, price)
        # one price leaves room under the threshold where a list falls evenly: give it back, list by list
        room = limit * (1 - 1e-9 * np.sign(limit)) - 1e-6 - self._bound(q, adds, level)
        for _ in range(len(self.depths) - 2):
            moved = False
            for j in range(q.shape[1]):
                up = np.maximum(level[:, j] - 1, 1)
                more = np.take_along_axis(adds[:, :, j], up[:, None], 1)[:, 0] - np.take_along_axis(adds[:, :, j], level[:, j, None], 1)[:, 0]
                fits = (level[:, j] > 1) & (more < room)
                level[:, j] = np.where(fits, up, level[:, j])
                room = np.where(fits, room - more, room)
                moved |= bool(fits.any())
            if not moved:
                break
        depth = self.depths[level]
        depth[whole] = n
        return depth

    def top_k(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(query_id, vec_id, score) of each query's k best among those that reach its ``floor``."""
        n, dim = self.x.shape
        out: list[tuple[int, int, int]] = []
        if not n or not len(query_ids):
            return out
        limit = self.peak * float(np.abs(queries).max(initial=0)) * max(1, dim)
        kind = "f8" if limit < 2**53 else "i8"  # exact either way, faster in floating point
        x, q = self.x.astype(kind, copy=False), queries.astype(kind)
        floor = np.full(len(q), LEAST) if floor is None else floor.copy()

        def head(i: int) -> None:
            """The k-th best score among the tops of the lists, where no floor is known yet."""
            tops = np.arange(min(n, max(16, k)))
            met = np.unique(self.lists[np.where(queries[i][None, :] > 0, n - 1 - tops[:, None], tops[:, None]), np.arange(dim)[None, :]])
            met = met[self.ids[met] != query_ids[i]]
            self.scored += len(met)
            if len(met) >= k:
                floor[i] = int(np.partition(x[met] @ q[i], len(met) - k)[len(met) - k])

        if dim:
            for i in np.flatnonzero(floor == LEAST):
                head(i)
        known = np.flatnonzero(floor > LEAST) if dim else np.zeros(0, "i8")
        depth = np.full((len(q), dim), n)
        for s in range(0, len(known), 1024):
            depth[known[s : s + 1024]] = self.stops(queries[known[s : s + 1024]], floor[known[s : s + 1024]])
        every = (depth.max(axis=1, initial=0) >= n) | (depth.sum(axis=1) >= n) if dim else np.ones(len(q), bool)

        def best(i: int, scores: np.ndarray, met: np.ndarray) -> None:
            own = (self.ids[met] != query_ids[i]) & (scores >= floor[i])
            scores, ids = np.rint(scores[own]).astype("i8") if kind == "f8" else scores[own], self.ids[met[own]]
            order = np.lexsort((ids, -scores))[:k]
            out.extend((int(query_ids[i]), a, b) for a, b in zip(ids[order].tolist(), scores[order].tolist(), strict=True))

        whole = np.arange(n)
        step = max(1, SCORES // n)
        full = np.flatnonzero(every)
        for s in range(0, len(full), step):
            for i, scores in zip(full[s : s + step], q[full[s : s + step]] @ x.T, strict=True):
                best(i, scores, whole)
        self.scored += n * len(full)
        for i in np.flatnonzero(~every):
            read = [self.lists[n - d :, j] if queries[i, j] > 0 else self.lists[:d, j] for j, d in enumerate(depth[i]) if d]
            met = np.unique(np.concatenate(read)) if read else np.zeros(0, "i8")
            self.scored += len(met)
            best(i, x[met] @ q[i], met)
        return out


def _searched(vectors: DataFrame, queries: DataFrame, cells: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in each of its cells; rows have dim, cell, vec_id, v and queries a floor."""
    rows = vectors.select("dim", "cell", F.lit(0).alias("kind"), "vec_id", "v", F.lit(LEAST).cast("long").alias("floor")).union(queries.select("dim", "cell", F.lit(1), "vec_id", "v", "floor"))

    def matrix(batches: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(batches).combine_chunks()
        v = t.column("v").combine_chunks()
        return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            dims, cell, kind = (batch.column(c).to_numpy() for c in ("dim", "cell", "kind"))
            changes = np.flatnonzero((np.diff(dims) != 0) | (np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
                if s == e:
                    continue
                part, key = batch.slice(s, e - s), (int(dims[s]), int(cell[s]))
                if key != now:
                    now, held, block = key, [], None
                if not kind[s]:
                    held.append(part)
                    continue
                if not held and block is None:
                    continue  # no vectors in this cell
                if block is None:
                    block, held = Block(*matrix(held, key[0])), []
                found = block.top_k(*matrix([part], key[0]), k, part.column("floor").to_numpy())
                q, i, score = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    dealt = rows.repartition(max(1, cells), "dim", "cell").sortWithinPartitions("dim", "cell", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int | None = None, query_rows: int = 1 << 18) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; both sides as ``quantised`` gives them.

    ``block_rows`` vectors form a block, by default a share for each core between 8,192 and 131,072;
    ``query_rows`` queries at most stream past one block in one task.
    """
    spark = vectors.sparkSession
    vectors, queries = cut(vectors), cut(queries)
    n, m = vectors.count(), queries.count()
    if block_rows is None:
        block_rows = min(1 << 17, max(1 << 13, -(-n // spark.sparkContext.defaultParallelism)))
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    pick = lambda total, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(total))
    every = lambda name, first, total: F.explode(F.sequence(F.lit(first), F.lit(total - 1))).alias(name)
    cell = lambda v, q, total: (F.col(v) * total + F.col(q)).alias("cell")

    def search(first: int, last: int, parts: int, asked: DataFrame) -> DataFrame:
        """Blocks first to last - 1, with the queries in ``parts`` parts."""
        here: Column = F.col("vb") < last if first == 0 else F.col("vb") >= first
        left = vectors.withColumn("vb", pick(blocks, 7)).filter(here).select("*", every("qb", 0, parts)).select("dim", "vec_id", "v", cell("vb", "qb", parts))
        right = asked.withColumn("qb", pick(parts, 11)).select("*", every("vb", first, last)).select("dim", "vec_id", "v", "floor", cell("vb", "qb", parts))
        return _searched(left, right, (last - first) * parts, k)

    # one block first, its queries over many tasks; its k-th scores are where all others start
    first = cut(search(0, 1, max(parts, -(-m // 4096)), queries.withColumn("floor", F.lit(LEAST).cast("long"))))
    if blocks == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = cut(queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("dim", "vec_id", "v", F.coalesce("floor", F.lit(LEAST).cast("long")).alias("floor")))
    return _best(first.union(search(1, blocks, parts, asked)), k).select("query_id", "rank", "vec_id", "score")
