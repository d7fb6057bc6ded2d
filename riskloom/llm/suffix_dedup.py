"""Removal of repeated passages through a sparse suffix array, sorted deep and shallow.

Every byte covered by a string of ``least`` bytes that starts at two or more places is removed.

1. Anchors. A window of ``least`` bytes is represented by the place of the least hash of 8 bytes
   in its first ``least // 2`` places. The choice depends on the window's bytes alone, so equal
   windows have equal anchors at equal distances. All windows of an anchor share the bytes just
   behind it; their hash is the anchor's key. Its context is the bytes of all its windows. Long
   texts are gone through in segments, so memory doesn't grow with them.
2. Counting. Keys that occur once cannot hold a repeat. A context that occurs twice or more is a
   repeat as a whole, which its count says; one representative of each kind goes on, with its count.
3. Sorting. Kinds that share their key with others are gathered by key. The suffixes at their
   anchors are sorted by multikey quicksort over 8-byte digits to a shallow depth; blind tries order
   the groups that still agree there. The bytes before the anchors are sorted likewise, backwards.
   Going through the suffix array's common prefixes from the longest down, neighbouring intervals
   are merged, the smaller into the larger; each suffix looks up its neighbours on the left side
   only. That gives the windows repeated elsewhere without comparing all pairs.
4. A key with more than ``group_rows`` kinds is split by depth until its parts can be sorted. Its
   windows are dealt out by how far they begin before the anchor, in spans of PARTS, then finer:
   those of a span share the bytes that all of them hold, so the hash of these is the part's key.
   A span of one place is a window itself, and what shares its key is repeated.

Rows with the same id and text are put together first and count with their number; their verdict is joined back
to all of them, dealt out over several tasks.

Keys and contexts with very many places are dealt out over several tasks where places are joined
with their counts.

Defined results: a null text is empty; matches never cross documents; rows with the same id and
text are copies of each other; a null id is a value like others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut, joined_to, small, spread_to

GRAM = 8
NO_ID = -(1 << 63)

#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 64


#: Window starts that are looked at together, and the spans that keys with too many kinds are split by.
SEGMENT = 1 << 22
PARTS = (64, 16, 4, 1)


def anchors(data: bytes, least: int, segment: int = SEGMENT) -> Iterator[tuple[int, int, int]]:
    """The anchors of a text, segment by segment; one whose windows start in two segments comes once for each."""
    for at in range(0, max(1, len(data) - least + 1), segment):
        for a, lo, hi in _anchors(data[at : at + segment + least - 1] if len(data) > segment else data, least):
            yield a + at, lo + at, hi + at


def _anchors(data: bytes, least: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first window start, last window start) for the windows of ``least`` bytes."""
    reach = min(least // 2, 250)
    n = len(data)
    if n < least:
        return
    raw = np.frombuffer(data, "u1")
    grams = np.lib.stride_tricks.sliding_window_view(raw, GRAM)
    x = np.ascontiguousarray(grams).view("<u8").ravel()
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    key = (x >> np.uint64(28)) << np.uint64(28) | np.arange(len(x), dtype="u8")
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    at = (key[: n - least + 1] & np.uint64((1 << 28) - 1)).astype("i8")
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], len(at)) - 1
    yield from zip(at[first].tolist(), first.tolist(), last.tolist(), strict=True)


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    v = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (v.bit_length() + 7) // 8


def _blind_trie(items: list[int], text: list[bytes], depth: int) -> list[int]:
    """``items`` in the order of their texts, which agree up to ``depth``.

    An inner node is [place, {byte or -1: child}]: the texts below agree up to ``place``, where the
    byte decides; a leaf is [-1, items]. An insertion descends by the deciding bytes alone, compares
    once with the leaf it meets, and splits the path at the common prefix.
    """
    digit = lambda s, p: s[p] if p < len(s) else -1
    root: list = [-1, [items[0]]]
    for item in items[1:]:
        s, node = text[item], root
        while node[0] >= 0:
            node = node[1].get(digit(s, node[0])) or next(iter(node[1].values()))
        other = text[node[1][0]]
        p = depth + common(s[depth:], other[depth:])
        if p == len(s) == len(other):
            node[1].append(item)
            continue
        node = root
        while 0 <= node[0] < p:
            node = node[1][digit(s, node[0])]
        if node[0] == p:
            node[1][digit(s, p)] = [-1, [item]]
        else:
            node[:] = [p, {digit(other, p): node[:], digit(s, p): [-1, [item]]}]
    out, stack = [], [root]
    while stack:
        place, below = stack.pop()
        if place < 0:
            out += below
        else:
            stack += [below[k] for k in sorted(below, reverse=True)]
    return out


def deep_shallow(text: list[bytes]) -> list[int]:
    """Indexes of ``text`` in order: multikey quicksort to SHALLOW bytes, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(text))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2 or depth < 0:
            out += items  # one text, or texts that have ended alike
        elif depth >= SHALLOW:
            out += _blind_trie(items, text, depth)
        else:
            digit = {i: (text[i][depth : depth + 8].ljust(8, b"\0"), min(8, len(text[i]) - depth)) for i in items}
            pivot = digit[items[len(items) // 2]]
            less, same, more = [], [], []
            for i in items:
                d = digit[i]
                (less if d < pivot else more if d > pivot else same).append(i)
            stack += [(more, depth), (same, depth + 8 if pivot[1] == 8 else -1), (less, depth)]
    return out


def repeated_windows(contexts: list[tuple[bytes, bytes, int, int]], least: int) -> dict[int, list[tuple[int, int]]]:
    """For each context the ranges of distances d (window start to anchor) of windows found in another context too.

    A context is (bytes before the anchor, reversed; bytes from the anchor; least d; largest d).
    """
    before, behind = [c[0] for c in contexts], [c[1] for c in contexts]
    found: dict[int, list[tuple[int, int]]] = {}

    def note(i: int, j: int, right: int, left: int) -> None:
        low, high = max(contexts[i][2], least - right), min(contexts[i][3], left)
        if low <= high:
            found.setdefault(i, []).append((low, high))

    order = deep_shallow(behind)
    at_left = deep_shallow(before)
    rank = [0] * len(contexts)
    for k, i in enumerate(at_left):
        rank[i] = k
    shared = [common(behind[a], behind[b]) for a, b in zip(order, order[1:], strict=False)]
    floor = least - max(c[3] for c in contexts)
    group = list(range(len(order)))
    held: list[list[int]] = [[rank[i]] for i in order]

    def find(k: int) -> int:
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    for k in sorted(range(len(shared)), key=lambda k: -shared[k]):
        right = shared[k]
        if right < floor:
            break
        a, b = find(k), find(k + 1)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        large = held[a]
        for r in held[b]:
            p = bisect.bisect_left(large, r)
            for q in large[max(0, p - 1) : p + 1]:
                i, j = at_left[r], at_left[q]
                left = common(before[i], before[j])
                note(i, j, right, left)
                note(j, i, right, left)
        for r in held[b]:
            bisect.insort(large, r)
        held[b], group[b] = [], a
    return found


def _anchor_rows(rows: DataFrame, least: int) -> DataFrame:
    """(k1, k2, key, context, place, copies) of every anchor; place packs the anchor and its largest and least distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            k1, k2, copies = (batch.column(k).to_numpy() for k in ("k1", "k2", "copies"))
            owner, keys, contexts, places = [], [], [], []
            fixed = least - min(least // 2, 250)
            for row, data in enumerate(batch.column("data")):
                data = data.as_py()
                for a, lo, hi in anchors(data, least):
                    owner.append(row)
                    keys.append(digest(data[a : a + fixed]))
                    contexts.append(digest(data[lo : hi + least], a - lo))
                    places.append(a << 16 | (a - lo) << 8 | (a - hi))
            owner = np.asarray(owner, "i8")
            as_long = lambda v: pa.array(np.asarray(v, "u8").view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(k1[owner]), pa.array(k2[owner]), as_long(keys), as_long(contexts), pa.array(np.asarray(places, "i8")), pa.array(copies[owner])], names=["k1", "k2", "key", "context", "place", "copies"])

    return rows.select("k1", "k2", "data", "copies").mapInArrow(run, "k1 long, k2 long, key long, context long, place long, copies long")


def _with_bytes(rows: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """Add each place's bytes before its anchor (reversed) and from it on.

    All columns of ``rows`` go through, so that the texts are shuffled in the same way, and but once,
    for this and for the cutting at the end.
    """
    listed = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "place", "once")).alias("places"))
    met = rows.join(listed, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, data, listed in zip(*(batch.column(k) for k in ("k1", "k2", "data", "places")), strict=True):
                k1, k2, data = k1.as_py(), k2.as_py(), data.as_py()
                for x in listed.as_py():
                    a, most, fewest = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    out.append((x["key"], k1, k2, x["place"], x["once"], data[a - most : a][::-1], data[a : a - fewest + least]))
            yield _batch(out, _CONTEXT)

    return met.mapInArrow(run, CONTEXT)


CONTEXT = "key long, k1 long, k2 long, place long, once boolean, before binary, behind binary"
SPANS = "k1 long, k2 long, s long, e long"
_CONTEXT = pa.schema([("key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), ("once", pa.bool_()), ("before", pa.binary()), ("behind", pa.binary())])
_SPANS = pa.schema([(k, pa.int64()) for k in ("k1", "k2", "s", "e")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, schema.types, strict=True)], schema=schema)


def _sorted_spans(contexts: DataFrame, least: int) -> DataFrame:
    """(k1, k2, s, e): repeated byte ranges of contexts that occur once, by the suffix array of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in _CONTEXT.names), strict=True))
        out: list[tuple[int, int, int, int]] = []
        for _, own in groupby(rows, key=lambda r: r[0]):
            own = list(own)
            found = repeated_windows([(r[5], r[6], r[3] & 255, r[3] >> 8 & 255) for r in own], least)
            for i, near in found.items():
                _, k1, k2, place, once, _, _ = own[i]
                if once:
                    out += [(k1, k2, (place >> 16) - high, (place >> 16) - low + least) for low, high in near]
            if len(out) >= 50_000:
                yield _batch(out, _SPANS)
                out.clear()
        yield _batch(out, _SPANS)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def _split(contexts: DataFrame, least: int, width: int) -> DataFrame:
    """The contexts' windows by spans of ``width`` distances to the anchor, keyed by the bytes that all windows of a span hold.

    A span of one distance is one window; its hash of 128 bits takes the place of the bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for _, k1, k2, place, once, before, behind in zip(*(batch.column(k).to_pylist() for k in _CONTEXT.names), strict=True):
                a, most, fewest = place >> 16, place >> 8 & 255, place & 255
                for span in range(fewest // width, most // width + 1):
                    low, high = span * width, (span + 1) * width - 1
                    own_low, own_high = max(low, fewest), min(high, most)
                    held = before[:low] + behind[: max(0, least - high)]
                    rest = (before[:own_high], behind[: least - own_low]) if width > 1 else (xxhash.xxh3_128_digest(held), b"")
                    out.append((digest(held, span << 8 | width) - (1 << 63), k1, k2, a << 16 | own_high << 8 | own_low, once, *rest))
            yield _batch(out, _CONTEXT)

    return contexts.mapInArrow(run, CONTEXT)


def _deep_spans(contexts: DataFrame, sizes: DataFrame, least: int, group_rows: int) -> DataFrame:
    """Repeated byte ranges of contexts whose keys have more kinds than can be gathered; ``sizes`` counts each key's rows as n."""
    result = None
    for width in PARTS:
        contexts = cut(_split(spread_to(contexts, sizes, ["key"]).select(*_CONTEXT.names), least, width))
        keys = ["key"] if width > 1 else ["key", "before"]
        counted = contexts.groupBy(*keys).agg(F.count("*").alias("n"))
        if width == 1:
            part = spread_to(contexts.filter("once"), cut(counted.filter("n > 1")), keys).select(*whole_range(least))
        else:
            sizes = cut(counted.filter(F.col("n") > group_rows))
            part = _sorted_spans(contexts.join(sizes, "key", "left_anti"), least)
        result = part if result is None else result.union(part)
        if width > 1 and sizes.isEmpty():
            break
    return result


def whole_range(least: int) -> list:
    """k1, k2, s, e of all windows of a place."""
    return [F.col("k1"), F.col("k2"), F.expr("(place >> 16) - (place >> 8 & 255)").alias("s"), F.expr(f"(place >> 16) - (place & 255) + {least}").alias("e")]


def repeated_spans(rows: DataFrame, least: int, group_rows: int = 20_000) -> DataFrame:
    """(k1, k2, s, e): byte ranges of ``rows`` (k1, k2, data, copies) that together are all bytes to remove.

    A row stands for as many equal ones as ``copies`` says, so (k1, k2) is there once.
    """
    found = _anchor_rows(rows, least)
    keys = cut(found.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("all"), (F.min("context") != F.max("context")).alias("mixed")).filter("all > 1").drop("all"))
    met = cut(spread_to(found, keys, ["key"]).drop("n"))
    whole = met.filter("NOT mixed").select(*whole_range(least))
    mixed = met.filter("mixed").drop("mixed")
    kinds = cut(mixed.groupBy("key", "context").agg(F.count("*").alias("n"), (F.sum("copies") == 1).alias("once"), F.min(F.struct("k1", "k2", "place")).alias("one")))
    copies = spread_to(mixed, kinds.filter("NOT once").select("key", "context", "n"), ["key", "context"]).select(*whole_range(least))
    shared = kinds.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("once").cast("int")).alias("single"))
    shared = cut(shared.filter("single > 0").select("key", "n"))
    open_kinds = cut(spread_to(kinds.select("key", "one", "once"), shared, ["key"]).select("key", "one.*", "once", "n"))
    result = whole.union(copies).union(_sorted_spans(_with_bytes(rows, open_kinds.filter(F.col("n") <= group_rows), least), least))
    sizes = cut(shared.filter(F.col("n") > group_rows))
    if not sizes.isEmpty():
        result = result.union(_deep_spans(_with_bytes(rows, open_kinds.filter(F.col("n") > group_rows), least), sizes, least, group_rows))
    return result


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [s, e) ranges."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _once_each(rows: DataFrame, several: DataFrame) -> DataFrame:
    """One row (k1, k2, data, copies) for all that share k1 and k2; ``several`` counts those that more than one row has as n.

    Copies are put together where they lie before they are shuffled.
    """
    counted = joined_to(rows, several, ["k1", "k2"], "left") if small(several) else spread_to(rows, several, ["k1", "k2"], "left", salt=F.monotonically_increasing_id())
    one = counted.filter("n IS NULL").select("k1", "k2", "data", F.lit(1).cast("long").alias("copies"))
    return one.union(counted.filter("n > 1").groupBy("k1", "k2").agg(F.first("data").alias("data"), F.first("n").alias("copies")))


def deduplicated(docs: DataFrame, least: int = 400, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = True, group_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, the spans and the kept text.

    ``keep`` names columns of ``docs`` to carry along. Where a cut splits a character, its left-over
    bytes are dropped from the kept text (not from the digest).
    """
    if not 2 * GRAM <= least:
        raise ValueError("strings must have at least 16 bytes")
    carried = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("data"), *carried)
    several = cut(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"))
    alone = several.isEmpty()
    texts = rows.withColumn("copies", F.lit(1).cast("long")) if alone else cut(_once_each(rows, several))
    runs = repeated_spans(texts, least, group_rows).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    if alone:
        met = rows.join(runs, ["k1", "k2"], "left")
    else:
        counted = cut(runs.join(several, ["k1", "k2"], "left").withColumn("n", F.coalesce("n", F.lit(1))))
        met = spread_to(rows, counted, ["k1", "k2"], "left", salt=F.monotonically_increasing_id()).drop("n")
    names = [f"kept_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, listed in zip(batch.column("data"), batch.column("spans"), strict=True):
                data, spans = data.as_py(), merged([(x["s"], x["e"]) for x in listed.as_py() or ()])
                parts, at = [], 0
                for s, e in spans:
                    parts.append(data[at:s])
                    at = e
                parts.append(data[at:])
                rest = b"".join(parts)
                row = (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
                out.append((*row, [{"s": s, "e": e} for s, e in spans], b"".join(p.decode("utf-8", "ignore").encode() for p in parts).decode()) if with_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * (6 if with_text else 4)
            made = [pa.array(v, t) for v, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *(batch.column(k) for k in names)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"][: len(made) + 1] + names)

    kinds = ", ".join(f"{k} {met.schema[k].dataType.simpleString()}" for k in names)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<s:long,e:long>>, kept_text string" * with_text + (f", {kinds}" if names else "")
    return met.mapInArrow(run, schema)
