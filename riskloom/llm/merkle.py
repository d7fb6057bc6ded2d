"""Merkle manifest of a table: leaf digests, a tree for each group, a tree over the groups' roots, and inclusion proofs.

1. Every row gets the SHA-256 of its columns; leaves are put in order by range partitions, and counts of
   the partitions give each leaf its index in its tree.
2. A task goes through the leaves of its part of a tree with a mountain-range stack: a run of nodes
   for each level, which carries into one node of the next level as soon as ``base`` children, or all
   that the level still has, are there. Nothing is padded; short last runs are hashed as they are.
   Runs whose other children lie in other parts are left over as peaks.
3. The peaks of MERGED parts next to each other go through the same stack, tier by tier, until
   each tree has one. The roots of the trees are the leaves of the tree above.
4. Back down: a node's siblings are those on its way to its peak, which its task knows, and those of the
   peak, which come from the tier above. So the leaves are never joined with all nodes of their paths.

Tasks hold one part, whose size the partitioning sets, and peaks are few: base * log(rows) for each side of a part.

Defined results: a null is encoded apart from every value; a null group is a tree of its own, the
first; leaves without an order key are the first of their tree, those with equal keys are ordered by their digest,
equal rows get places one after another; an empty table has no leaves; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import cut, joined_to

#: Parts whose peaks are merged by one task.
MERGED = 64

#: Bits of monotonically_increasing_id that count rows inside a partition.
ROW_BITS = (1 << 33) - 1


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: Sequence[Column]) -> Column:
    """SHA-256, in lowercase hex, of the values' fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def indexed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a string ``tree``) with ``part``, ``idx`` and ``size``: places by ``order`` in each tree of so many leaves.

    Ranges are cut by a key of each row alone, so equal rows don't meet in one partition.
    """
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row_")]
    named = cut(rows.withColumn("row_", F.monotonically_increasing_id()))
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(dealt.drop("row_").withColumns({"part": F.spark_partition_id().cast("long"), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}))
    counts = placed.groupBy("tree", "part").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    whole = W.partitionBy("tree")
    before = F.coalesce(F.sum("n_").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("tree", "part", (before - F.col("first_")).alias("shift_"), F.sum("n_").over(whole).alias("size")))
    return joined_to(placed, offsets, ["tree", "part"], "inner").withColumn("idx", F.col("at_") + F.col("shift_")).drop("at_", "shift_")


class Mountains:
    """The stack of open runs of one part of a tree of ``size`` leaves; nodes are added from left to right."""

    def __init__(self, size: int, base: int):
        self.base, self.widths = base, [size]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // base))
        self.open: dict[int, tuple[int, list[str]]] = {}
        self.runs: dict[tuple[int, int], list[str]] = {}
        self.peaks: list[tuple[int, int, str]] = []

    def add(self, level: int, idx: int, node: str) -> None:
        while True:
            if self.widths[level] == 1:
                self.peaks.append((level, idx, node))
                return
            first, run = self.open.setdefault(level, (idx, []))
            run.append(node)
            if (idx + 1) % self.base and idx + 1 < self.widths[level]:
                return
            del self.open[level]
            if first % self.base:
                self._leave(level, first, run)
                return
            level, idx = level + 1, idx // self.base
            self.runs[level, idx] = run
            node = hashed(run)

    def _leave(self, level: int, first: int, run: list[str]) -> None:
        self.peaks += [(level, first + k, x) for k, x in enumerate(run)]

    def closed(self) -> Mountains:
        for level in sorted(self.open, reverse=True):
            self._leave(level, *self.open[level])
        self.open.clear()
        return self

    def way(self, level: int, idx: int) -> tuple[list[tuple[int, list[str]]], tuple[int, int]]:
        """The steps (place in the run, the run's other nodes) from a node up to its peak, and the peak's place."""
        steps = []
        while run := self.runs.get((level + 1, idx // self.base)):
            k = idx % self.base
            steps.append((k, run[:k] + run[k + 1 :]))
            level, idx = level + 1, idx // self.base
        return steps, (level, idx)


def hashed(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def folded(node: str, steps: Sequence[tuple[int, list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for k, others in steps:
        node = hashed([*others[:k], node, *others[k:]])
    return node


def proof(steps: Sequence[tuple[int, list[str]]]) -> str:
    return hashed([x for _, others in steps for x in others])


NODE = "tree string, part long, level long, idx long, size long, digest string"
_NODE = pa.schema([("tree", pa.string()), *((k, pa.int64()) for k in ("part", "level", "idx", "size")), ("digest", pa.string())])
_STEPS = pa.list_(pa.struct([("at", pa.int64()), ("others", pa.list_(pa.string()))]))
ABOVE = "tree string, part long, level long, idx long, subroot string, root string, steps array<struct<at:long,others:array<string>>>"
_ABOVE = pa.schema([("tree", pa.string()), *((k, pa.int64()) for k in ("part", "level", "idx")), ("subroot", pa.string()), ("root", pa.string()), ("steps", _STEPS)])


def _table(rows: Sequence[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _stacked(nodes: pa.Table, base: int) -> tuple[Mountains | None, list[tuple]]:
    """The stack after all nodes of a part, and the nodes (level, idx, row of the table) from left to right."""
    if not nodes.num_rows:
        return None, []
    level, idx, own = (nodes.column(k).to_pylist() for k in ("level", "idx", "digest"))
    order = sorted(range(len(idx)), key=lambda r: idx[r] * base ** level[r])
    stack = Mountains(nodes.column("size")[0].as_py(), base)
    for r in order:
        stack.add(level[r], idx[r], own[r])
    return stack.closed(), [(level[r], idx[r], r) for r in order]


def peaks(nodes: DataFrame, base: int) -> DataFrame:
    """What the stacks of all parts leave over, as nodes of the same form."""

    def run(table: pa.Table) -> pa.Table:
        stack, _ = _stacked(table, base)
        tree, part, size = (table.column(k)[0].as_py() for k in ("tree", "part", "size"))
        return _table([(tree, part, level, idx, size, x) for level, idx, x in stack.peaks], _NODE)

    return nodes.select(*_NODE.names).groupBy("tree", "part").applyInArrow(run, NODE)


def node_records(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes (tree, level, idx, digest, children) that the stacks of all parts complete."""
    schema = pa.schema([("tree", pa.string()), ("level", pa.int64()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        stack, _ = _stacked(table, base)
        tree = table.column("tree")[0].as_py()
        return _table([(tree, *place, hashed(run), len(run)) for place, run in stack.runs.items()], schema)

    return nodes.select(*_NODE.names).groupBy("tree", "part").applyInArrow(run, "tree string, level long, idx long, digest string, children long")


def tiers(leaves: DataFrame, base: int, merged: int = MERGED) -> tuple[list[DataFrame], DataFrame]:
    """The nodes that each tier starts from, the leaves first, and at last one node for each tree.

    Nodes of later tiers have the part they come from as ``came``.
    """
    found, nodes = [leaves], leaves
    while True:
        left = cut(peaks(nodes, base))
        nodes = left.withColumnRenamed("part", "came").withColumn("part", F.floor(F.col("came") / merged).cast("long"))
        if left.groupBy("tree").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return found, nodes
        found.append(nodes)


def _ways(own: pa.Table, over: pa.Table, base: int) -> Iterator[tuple]:
    """(row, level, idx, subroot, root, steps) of a part's nodes; ``over`` has what is known of the peaks it left over."""
    stack, order = _stacked(own, base)
    known = {}
    for level, idx, subroot, root, steps in zip(*(over.column(k).to_pylist() for k in ("level", "idx", "subroot", "root", "steps")), strict=True):
        known[level, idx] = subroot, root, [(s["at"], s["others"]) for s in steps]
    for level, idx, r in order:
        steps, peak = stack.way(level, idx)
        subroot, root, rest = known[peak]
        yield r, level, idx, subroot, root, steps + rest


def descended(nodes: DataFrame, above: DataFrame, base: int) -> DataFrame:
    """ABOVE for a tier's nodes, their part being the one they came from, out of ABOVE for the peaks that their parts left over."""

    def run(own: pa.Table, over: pa.Table) -> pa.Table:
        tree, came = own.column("tree").to_pylist(), own.column("came").to_pylist()
        return _table([(tree[r], came[r], level, idx, subroot, root, [{"at": k, "others": x} for k, x in steps]) for r, level, idx, subroot, root, steps in _ways(own, over, base)], _ABOVE)

    return nodes.groupBy("tree", "part").cogroup(above.groupBy("tree", "part")).applyInArrow(run, ABOVE)


def roots(tops: DataFrame, base: int) -> DataFrame:
    """ABOVE for the tops of all trees: the tree of their digests, in order of the trees' names."""
    named = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "came", F.col("level").alias("top_level"), F.col("idx").alias("top_idx"), "digest")
    leaves = cut(indexed(named, ["name"]).withColumn("level", F.lit(0).cast("long")))
    found, last = tiers(leaves.select(*_NODE.names), base)
    nothing = F.expr("CAST(array() AS array<struct<at:bigint,others:array<string>>>)")
    above = last.select("tree", F.col("came").alias("part"), "level", "idx", F.lit("").alias("subroot"), F.col("digest").alias("root"), nothing.alias("steps"))
    for nodes in [*reversed(found[1:]), found[0].withColumn("came", F.col("part"))]:
        above = descended(nodes, above, base)
    met = leaves.select("name", "came", "top_level", "top_idx", "digest", "idx").join(above.select("idx", "root", "steps"), "idx")
    return met.select(F.col("name").alias("tree"), F.col("came").alias("part"), F.col("top_level").alias("level"), F.col("top_idx").alias("idx"), F.col("digest").alias("subroot"), "root", "steps")


def manifest(rows: DataFrame, base: int = 2, merged: int = MERGED) -> DataFrame:
    """Per row of (id, tree, order, leaf, other): id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tree`` may be null; leaves are ordered by ``order``, then ``leaf``. The root is folded from ``other``
    where it isn't null, else from ``leaf``, so that a row that was changed doesn't verify.
    """
    leaves = indexed(_leaves(rows), ["order", "digest"]).withColumn("level", F.lit(0).cast("long"))
    found, tops = tiers(leaves, base, merged)
    above = cut(roots(tops, base))
    for nodes in reversed(found[1:]):
        above = descended(nodes, above, base)
    schema = pa.schema([("id", pa.int64()), *((k, pa.string()) for k in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def run(own: pa.Table, over: pa.Table) -> pa.Table:
        ids, leaf, other = (own.column(k).to_pylist() for k in ("id", "digest", "other"))
        out = []
        for r, _, _, subroot, root, steps in _ways(own, over, base):
            end = folded(leaf[r] if other[r] is None else other[r], steps)
            out.append((ids[r], leaf[r], subroot, root, proof(steps), end, end == root))
        return _table(out, schema)

    return leaves.groupBy("tree", "part").cogroup(above.groupBy("tree", "part")).applyInArrow(run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _leaves(rows: DataFrame) -> DataFrame:
    """Trees are named so that a null group is the first and the names' order is that of their bytes."""
    return rows.select("id", F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit("")).alias("tree"), "order", F.col("leaf").alias("digest"), "other")


def manifest_nodes(rows: DataFrame, base: int = 2, merged: int = MERGED) -> DataFrame:
    """(tree, level, idx, digest, children): all inner nodes of the groups' trees over the same rows as ``manifest``; a null group's tree is null."""
    found, _ = tiers(indexed(_leaves(rows), ["order", "digest"]).withColumn("level", F.lit(0).cast("long")), base, merged)
    result = node_records(found[0], base)
    for nodes in found[1:]:
        result = result.union(node_records(nodes, base))
    return result.withColumn("tree", F.when(F.col("tree") != "", F.expr("substr(tree, 2)")))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(id, tree, order, leaf, other) of documents: trees by lang, leaves by doc_id; ``other`` is the leaf of a row changed by hand.

    Rows whose doc_id has a CRC-32 that 7 divides have 1 added to n_chars there; rows without an id or n_chars are not changed.
    """
    of = lambda n: digest([F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n, F.col("text")])
    n = F.col("n_chars").cast("long")
    changed = (F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 0) & n.isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("order"), of(n).alias("leaf"), F.when(changed, of(n + 1)).alias("other"))
