"""SimHash near-duplicates by a binary trie self-join.

Each text gets a 64-bit fingerprint: the majority of every bit over the hashes of its word
shingles. Equal fingerprints form a class; only one row per class is joined. Cut into ``budget + c``
blocks of bits, two fingerprints within ``budget`` differing bits agree on ``c`` blocks at least, so
classes are dealt by the values of each ``c`` blocks, with ``c`` growing with the logarithm of their
number; inside each such group a binary trie over the sorted fingerprints is joined with itself: pairs of nodes descend together, add up differing bits, and are dropped as soon
as the budget is exceeded. A task gives back a spanning forest of its links, never all pairs.

Groups that grow beyond ``group_rows`` are split again by the same argument on their free bits, up
to two times, and no link is lost. Many groups share one task's arrays.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; equal rows share a class; an empty table gives
no rows; rows without an id link and are linked like any other but never name a component; other
columns are ignored.

A Jaccard similarity of 0.8 (``without_similar``) goes through the same steps, twice. Texts with one
and the same set of shingles form a class. First the trie self-join above links all classes within
NARROW bits, and its links are compared exactly. Such a similarity asks for wider budgets too, which
leave no block of bits that near texts must share. There groups are dealt by MinHash: the texts of a
group share one of BANDS bands of ROWS minima, and a pair at 0.8 shares none with a probability of
1.3e-7. The trie self-join searches each group whose classes are still in different components for
fingerprints within WIDE bits (a pair at 0.8 differs in 9.7 of 64 on average and in more than WIDE
with a probability of 2e-4), and what it finds is compared exactly, in the group's task, from which
only the links of a spanning forest go back. So no pair of different sets is compared but those that
the trie gives. Of groups with the same classes one is searched; a pair is looked at in the first band
that it shares. Groups that are
still large are dealt again by each further band that their texts share. Empty texts have one class,
rows need no id, and rows that share one are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, joined_to, spread_to
from riskloom.llm.components import components

BANDS, ROWS = 40, 5
#: Differing bits of 64 that the trie allows where exact comparison follows.
WIDE = 20
#: Differing bits of the trie self-join over all classes, which comes first, and its rounds, each with other links of a class.
NARROW, STAR_ROUNDS = 4, 1
#: Shingles whose minima are taken at once.
CHUNK = 1024

_DRAW = np.random.default_rng(42)
FACTORS = (_DRAW.integers(0, 2**63, (BANDS * ROWS, 1), dtype="u8") << np.uint64(1)) | np.uint64(1)
SHIFTS = _DRAW.integers(0, 2**63, (BANDS * ROWS, 1), dtype="u8")

#: Node pairs that a task expands at once.
FRONTIER = 1 << 18


def shingle_hashes(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The hash of every word shingle of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)], "<u8", n)


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def majority(hashes: np.ndarray) -> int:
    """The majority of every bit."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.unpackbits(hashes.view("u1").reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column(1)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8"))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def block_masks(free: int, blocks: int) -> list[int]:
    """Masks that cut the bits set in ``free`` into ``blocks`` runs of near equal length."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in part) for k in range(blocks) if (part := bits[k * len(bits) // blocks : (k + 1) * len(bits) // blocks])]


def bits_first(fps: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprints with the bits of ``mask`` moved to the top; distances stay as they are."""
    order = [i for i in range(63, -1, -1) if mask >> i & 1] + [i for i in range(63, -1, -1) if not mask >> i & 1]
    out = np.zeros_like(fps)
    for i in order:
        out = out << np.uint64(1) | fps >> np.uint64(i) & np.uint64(1)
    return out


def trie_links(fps: np.ndarray, fixed: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within ``budget`` bits among sorted, distinct ``fps`` that agree on their first ``fixed`` bits."""
    top = fps >> np.uint64(64 - fixed) if fixed else np.zeros(len(fps), "u8")
    starts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    ends = np.append(starts[1:], len(fps))
    keep = ends - starts > 1
    starts, ends = starts[keep], ends[keep]
    stack = [(63 - fixed, starts, ends, starts, ends, np.zeros(len(starts), "i1"))]
    while stack:
        bit, ul, uh, vl, vh, err = stack.pop()
        if len(ul) > FRONTIER:
            stack += [(bit, *(x[k : k + FRONTIER] for x in (ul, uh, vl, vh, err))) for k in range(0, len(ul), FRONTIER)]
            continue
        leaf = (uh - ul == 1) & (vh - vl == 1)
        if leaf.any():
            i, j = ul[leaf], vl[leaf]
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (i < j)
            if near.any():
                yield i[near], j[near]
            ul, uh, vl, vh, err = (x[~leaf] for x in (ul, uh, vl, vh, err))
        if not len(ul) or bit < 0:
            continue
        one, above = np.uint64(1 << bit), np.uint64((1 << 64) - (2 << bit))
        middle = lambda lo, hi: np.clip(np.searchsorted(fps, (fps[lo] & above) | one), lo, hi)
        um, vm = middle(ul, uh), middle(vl, vh)
        same = (ul == vl) & (uh == vh)
        below = [(ul, um, vl, vm, err, True), (um, uh, vm, vh, err, True), (ul, um, vm, vh, err + 1, True), (um, uh, vl, vm, err + 1, ~same)]
        kept = []
        for a, b, c, d, e, ok in below:
            ok = ok & (b > a) & (d > c) & (e <= budget) & ((d - c > 1) | (b - a > 1) | (a != c))
            kept.append([x[ok] for x in (a, b, c, d, e)])
        stack.append((bit - 1, *map(np.concatenate, zip(*kept, strict=True))))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> np.ndarray:
    """For each node the node of least ``rank`` among those that ``pairs`` connect it with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            swap = rank[a] < rank[b]
            high, low = np.where(swap, b, a), np.where(swap, a, b)
            order = np.lexsort((-rank[low], high))  # the last write wins: the least rank
            root[high[order]] = low[order]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def near_links(classes: DataFrame, budget: int = 4, group_rows: int = 20_000, task_rows: int = 250_000) -> DataFrame:
    """Links (a, b) between class ids whose fingerprints differ in at most ``budget`` bits; enough of them to connect all that are linked.

    ``classes`` has distinct ``fp`` and the class id ``rep``.
    """
    spark = classes.sparkSession
    n = classes.count()
    whole = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    blocks = budget + 1
    same = next((c for c in range(1, 5) if n <= 4 * 2 ** (64 * c // (budget + c))), 5)

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for m in masks])).alias("k")
        return rows.select("fp", "rep", keys).select("fp", "rep", "k.mask", "k.key")

    masks = [sum(part) for part in combinations(block_masks(whole, budget + same), same)]
    first, level, ready = masks, dealt(classes, masks), []
    for _ in range(2 * (n > group_rows)):
        level = cut(level)
        large = cut(level.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("mask", "key"))
        if large.isEmpty():
            break
        ready.append(level.join(large, ["mask", "key"], "left_anti"))
        rest = level.join(large, ["mask", "key"], "left_semi")
        finer = {m: [m | s for s in block_masks(whole & ~m, blocks)] for m in masks}
        level = None
        for m, below in finer.items():
            part = dealt(rest.filter(F.col("mask") == F.lit(signed(m)).cast("long")).select("fp", "rep"), below)
            level = part if level is None else level.union(part)
        masks = [x for below in finer.values() for x in below]
    for part in ready:
        level = level.union(part.select("fp", "rep", "mask", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        fps, rep, mask = (rows.column(k).to_numpy() for k in ("fp", "rep", "mask"))
        for m in np.unique(mask):
            own, bits = mask == m, int(m) % (1 << 64)
            f, r = bits_first(fps[own].view("u8"), bits), rep[own]
            f, once = np.unique(f, return_index=True)  # two splits can deal a fingerprint out under one mask
            r = r[once]
            found = forest(len(f), trie_links(f, bits.bit_count(), budget), r)
            moved = np.flatnonzero(found != np.arange(len(f)))
            yield pa.RecordBatch.from_arrays([pa.array(r[moved]), pa.array(r[found[moved]])], names=["a", "b"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(first) // task_rows))
    return level.repartition(parts, "mask", "key").mapInArrow(run, "a long, b long")


def placed(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(fp, component, component_id, n) of the classes of ``n`` rows (doc_id, fp): the least fp and the least doc_id that links reach."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    linked = components(near_links(classes.select("fp", F.col("fp").alias("rep")), budget), "a", "b").withColumnRenamed("node", "fp")
    linked = cut(linked)
    named = cut(linked.join(classes, "fp").groupBy("component").agg(F.min("rep").alias("named"), F.count("*").alias("fps")))
    own = classes.join(spread_to(linked, named, ["component"], rows="fps"), "fp", "left")
    return own.select("n", "fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("named")).alias("component_id"))


def grouped(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp): the least doc_id that links reach."""
    return spread_to(fps, cut(placed(fps, budget)), ["fp"], salt=F.monotonically_increasing_id()).drop("component", "n")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, row, id, text): every row with a key of its own, which stays once the table is cut."""
    return docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def one_of_each(rows: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """Of rows (key, row, id, ``node``) one for each component of ``linked`` (``node``, component): that of the least id, if any has one."""
    classes = rows.groupBy(node).agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "key")).alias("best"))
    kept = classes.join(linked, node, "left").groupBy(F.coalesce("component", node).alias("c")).agg(F.min("best").alias("best")).select("best.key")
    gone = cut(rows.select("key").join(kept, "key", "left_anti"))
    return joined_to(rows.select("key", "row"), gone, ["key"], "left_anti").select("row.*")


def near_duplicates(docs: DataFrame, budget: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and component_id, the least doc_id that links reach."""
    found = grouped(cut(fingerprints(docs, shingle, id_col, text_col)), budget)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, budget: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: that of the least id, if any has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column("text")), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "row", "id")), pa.array(found.view("i8"))], names=["key", "row", "id", "fp"])

    rows = keyed(docs, id_col, text_col)
    rows = cut(rows.mapInArrow(run, rows.select("key", "row", "id", F.lit(0).cast("long").alias("fp")).schema))
    return one_of_each(rows, placed(rows.select(F.col("id").alias("doc_id"), "fp"), budget).select("fp", "component"), "fp")


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of a set of shingles; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[k : k + CHUNK] * FACTORS + SHIFTS).min(axis=1), out=least)
    digest = xxhash.xxh3_64_intdigest
    keys = np.fromiter((digest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))), "u8", BANDS)
    return keys.view("i8").tolist()


def classed(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(key, row, id, node, fp, n, bands): every row with a key of its own and its class ``node``, whose set of ``n`` shingles has the fingerprint ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda values, k: pa.array(np.fromiter(values, "u8", k).view("i8"))
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or "", shingle)) for t in batch.column("text")]
            nodes, fps = longs((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), len(sets)), longs(map(majority, sets), len(sets))
            found = [nodes, fps, pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "row", "id")), *found], names=["key", "row", "id", "node", "fp", "n", "bands"])

    rows = keyed(docs, id_col, text_col)
    zero = F.lit(0).cast("long")
    out = rows.select("key", "row", "id", zero.alias("node"), zero.alias("fp"), zero.alias("n"), F.array().cast("array<long>").alias("bands")).schema
    return rows.mapInArrow(run, out)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py() or "", shingle)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both / (len(x) + len(y) - both) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one = joined_to(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), pairs, ["b"], "inner")
    two = joined_to(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), cut(pairs.select("a").distinct()), ["a"], "left_semi")
    return one.join(two, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class _Group:
    """The classes of one group: fingerprints, components, bands and sets of shingles."""

    def __init__(self, t: pa.Table):
        self.g = int(t.column("g")[0].as_py())
        column = lambda k: t.column(k).to_numpy()
        order = np.argsort(column("fp").view("u8"), kind="stable")
        self.node, self.fp = column("node")[order], column("fp").view("u8")[order]
        _, self.component = np.unique(column("component")[order], return_inverse=True)
        self.bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        hashes = t.column("hashes").to_pylist()
        self.sets = [np.frombuffer(hashes[k], "u8") for k in order]
        self.size = np.array([len(x) for x in self.sets])
        self.postings: tuple | None = None

    def candidates(self, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within ``budget`` bits in different components that this group is to look at, by the trie self-join."""
        first = np.flatnonzero(np.concatenate(([True], self.fp[1:] != self.fp[:-1])))  # classes may share a fingerprint
        count = np.diff(np.append(first, len(self.fp)))

        def expanded(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = count[i] * count[j]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(i, n), np.repeat(j, n)
            return first[i] + inner // count[j], first[j] + inner % count[j]

        same = np.flatnonzero(count > 1)
        for i, j in ([(same, same)] if len(same) else []) + [(i[k : k + 8192], j[k : k + 8192]) for i, j in trie_links(self.fp[first], 0, budget) for k in range(0, len(i), 8192)]:
            x, y = expanded(i, j)
            for k in range(0, len(x), 1 << 15):
                u, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
                apart = (u != v) & (self.component[u] != self.component[v])
                u, v = u[apart], v[apart]
                shared, own = self.bands[u] == self.bands[v], self.bands[u] == self.g
                here = ~own.any(axis=1) | (shared.argmax(axis=1) == own.argmax(axis=1))
                yield u[here], v[here]

    def overlaps(self, x: int) -> np.ndarray:
        """How many shingles each class of the group has in common with class ``x``."""
        if self.postings is None:
            _, kind = np.unique(np.concatenate(self.sets), return_inverse=True)
            start = np.concatenate(([0], np.cumsum(np.bincount(kind))))
            owner = np.repeat(np.arange(len(self.sets)), self.size)[np.argsort(kind, kind="stable")]
            self.postings = kind, np.concatenate(([0], np.cumsum(self.size))), start, owner
        kind, at, start, owner = self.postings
        own = kind[at[x] : at[x + 1]]
        n = start[own + 1] - start[own]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[own], n)
        return np.bincount(owner[places], minlength=len(self.sets))

    def links(self, least: float, budget: int) -> Iterator[tuple[int, int]]:
        """Nodes of classes whose Jaccard similarity is ``least`` or more: as many pairs as it takes to connect their components."""
        root = list(range(int(self.component.max()) + 1))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for u, v in self.candidates(budget):
            order = np.argsort(u, kind="stable")
            u, v = u[order], v[order]
            cuts = np.flatnonzero(np.diff(u)) + 1
            for x, near in zip(u[np.concatenate(([0], cuts))].tolist() if len(u) else [], np.split(v, cuts), strict=False):
                near = [y for y in near.tolist() if find(self.component[x]) != find(self.component[y])]
                if not near:
                    continue
                both = self.overlaps(x)
                for y in near:
                    i, j = find(self.component[x]), find(self.component[y])
                    if i != j and both[y] >= least * (self.size[x] + self.size[y] - both[y]) - 1e-9:
                        root[i] = j
                        yield int(self.node[x]), int(self.node[y])


def _group_links(groups: DataFrame, least: float, budget: int) -> DataFrame:
    """Links (a, b) of the classes of each group (rows g, node, fp, component, bands, hashes), one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            rows = [(min(x), max(x)) for x in out]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and held[0].column("g")[0].as_py() != g[s]:
                    out += _Group(pa.Table.from_batches(held)).links(least, budget)
                    held.clear()
                held.append(batch.slice(s, e - s))
            if len(out) >= 50_000:
                yield flush()
        if held:
            out += _Group(pa.Table.from_batches(held)).links(least, budget)
        yield flush()

    return groups.repartition("g").sortWithinPartitions("g").select("g", "node", "fp", "component", "bands", "hashes").mapInArrow(run, "a long, b long")


def _dealt_again(members: DataFrame, group_rows: int, levels: int = 3) -> DataFrame:
    """``members`` (g, node, fp, component, bands) with groups of more than ``group_rows`` dealt again by each further band."""
    ready, level = None, members
    for _ in range(levels):
        level = cut(level)
        large = cut(level.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group_rows).select("g"))
        if large.isEmpty():
            break
        part = joined_to(level, large, ["g"], "left_anti")
        ready = part if ready is None else ready.union(part)
        finer = joined_to(level, large, ["g"], "left_semi").withColumn("band", F.explode("bands")).filter("band <> g")
        level = finer.withColumn("g", F.xxhash64("g", "band")).drop("band").distinct()
    return level if ready is None else ready.union(level.select(*ready.columns))


def _close_pairs(rows: DataFrame, classes: DataFrame, rounds: int) -> DataFrame:
    """Pairs (a, b) of classes within NARROW bits that the trie self-join gives, enough to connect all that are; each round prefers other links.

    ``classes`` (fp, rep, last) has the least and greatest class of each fingerprint. Different sets of one fingerprint are paired with the least.
    """
    twins = joined_to(rows.select("fp", "node").distinct(), cut(classes.filter("rep < last").select("fp", "rep")), ["fp"], "inner").filter("node <> rep")
    found = twins.select(F.col("rep").alias("a"), F.col("node").alias("b"))
    for k in range(rounds):
        mixed = lambda c: F.col(c).bitwiseXOR(F.lit(int(SHIFTS[k, 0] >> np.uint64(1)) * (k > 0)).cast("long"))  # noqa: B023, E731
        links = near_links(classes.select("fp", mixed("rep").alias("rep")), NARROW).select(mixed("a").alias("a"), mixed("b").alias("b"))
        found = found.union(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.distinct()


def _to_search(placed: DataFrame) -> DataFrame:
    """The groups ``g`` of ``placed`` (at, g, node, component) that join different components; of those with the same classes the one of the first band.

    A pair is looked at in the first band that it shares, so that none is lost with the other groups.
    """
    groups = placed.groupBy("g").agg(F.min("at").alias("at"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *[F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)])
    return cut(groups.filter("low < high").groupBy("n", "s0", "s1").agg(F.min_by("g", "at").alias("g")).select("g"))


def similar_links(rows: DataFrame, shingle: int, least: float, text_col: str, budget: int = WIDE, group_rows: int = 2_000) -> DataFrame:
    """(node, component) of the classes that are linked with others; ``rows`` as ``classed`` gives them."""
    spread = rows.select(F.posexplode("bands").alias("at", "g"), "node", "fp")
    shared = cut(spread.groupBy("g").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("g"))
    members = cut(joined_to(spread, shared, ["g"], "left_semi").distinct())
    classes = cut(rows.groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("last")))
    close = cut(_close_pairs(rows, classes, STAR_ROUNDS))
    some = cut(members.select("node").union(close.select("a")).union(close.select("b")).distinct())
    own = joined_to(rows.select("node", "key", "bands"), some, ["node"], "left_semi").groupBy("node").agg(F.min_by("bands", "key").alias("bands"), F.min("key").alias("key"))
    own = cut(own)
    sets = cut(_sets(joined_to(rows.select("key", F.col("row").getField(text_col).alias("text")), own.select("key", "node"), ["key"], "inner"), shingle))
    found = cut(similar(close, sets, least))
    linked = cut(components(found, "a", "b"))
    placed = cut(members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    left = joined_to(placed, _to_search(placed), ["g"], "left_semi").drop("at")
    dealt = _dealt_again(left.join(own.select("node", "bands"), "node"), group_rows)
    return components(found.union(cut(_group_links(dealt.join(sets, "node"), least, budget))), "a", "b")


def without_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row of ``docs`` for each group of texts linked by a Jaccard similarity of ``least`` or more, with all its columns: that of the least id, if any has one."""
    rows = cut(classed(docs, shingle, id_col, text_col))
    return one_of_each(rows, similar_links(rows, shingle, least, text_col, **limits), "node")
