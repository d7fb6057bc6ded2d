"""Maximal periodic runs of words, found by the runs theorem, and texts without the repeats.

A run is a stretch of words with least period q, as long as can be with it. By the runs theorem the
run's Lyndon root, taken by the order in which the word behind the run is the smaller one, is the longest
Lyndon word at its place. So it is enough to look at one word for each place and order:

1. The texts of a batch are coded word by word into one sequence, a mark of its own behind each text.
   Prefix doubling over the groups that still agree gives the suffix array, its inverse, and the
   common prefixes of neighbours.
2. The longest Lyndon word at place i ends before the next smaller value of the inverse suffix array,
   by the reversed order before the next larger one. Its length is a candidate period.
3. The candidate is extended to the right by the longest common extension of i and i + q: a range
   minimum over the neighbours' common prefixes, by a sparse table over blocks. What repeats
   often enough is extended to the left in the same way, on the reversed text.

A text is wholly in one batch, and batches hold about BATCH_WORDS words, so memory is bounded by
that or the longest text. Rows stay where they are; nothing is shuffled.

Defined results: words are what stands between ASCII white space; a null or empty text has no words,
no runs and the empty collapsed text; repeated rows and ids give a row each; a null id stays null; an
empty table gives no rows; other columns are ignored unless ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a batch that are looked at together; a longer text is a batch of its own.
BATCH_WORDS = 150_000

#: Neighbouring common prefixes whose minimum is one entry of the sparse table.
BLOCK = 16


class Suffixes:
    """Suffix array of a sequence whose suffixes all differ within it: place of each rank, rank of each place, longest common extensions."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        rank = self._settled(np.arange(n), codes[order])
        place = np.empty(n, "i8")
        place[order] = rank
        levels, width = [place.copy()], 1
        open_at = self._open(rank, np.arange(n))
        while len(open_at):
            own = order[open_at]
            key = place[own] * n + place[own + width]
            by = np.argsort(key, kind="stable")
            order[open_at] = own = own[by]
            rank = self._settled(open_at, key[by])
            place[own] = rank
            levels.append(place.copy())
            open_at = self._open(rank, open_at)
            width *= 2
        self.order, self.place = order, place
        self._blocks(self._neighbours(levels))

    @staticmethod
    def _settled(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The first place of each entry's group of equal keys."""
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(first, at, 0))

    @staticmethod
    def _open(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places whose group has other members."""
        same = rank[1:] == rank[:-1]
        return at[np.append(same, False) | np.insert(same, 0, False)] if len(rank) else at

    def _neighbours(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order: equal ranks of a level are equal words of twice the level before."""
        found = np.zeros(len(self.order), "i8")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        at = np.arange(1, len(self.order))
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            found[at[same]] += 1 << k
            a, b = a + (same << k), b + (same << k)
        return found

    def _blocks(self, shared: np.ndarray) -> None:
        self.shared = shared
        width = -(-len(shared) // BLOCK)
        padded = np.full(width * BLOCK, np.iinfo("i8").max)
        padded[: len(shared)] = shared
        self.table = [padded.reshape(width, BLOCK).min(axis=1)]
        while 2 << (len(self.table) - 1) <= width:
            step = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of each pair of different places."""
        low, high = np.minimum(self.place[i], self.place[j]) + 1, np.maximum(self.place[i], self.place[j])
        found = np.minimum(self.shared[low], self.shared[high])
        first, last = low // BLOCK + 1, high // BLOCK - 1
        whole = np.flatnonzero(first <= last)
        if len(whole):
            level = np.floor(np.log2(last[whole] - first[whole] + 1)).astype("i8")
            for k in np.unique(level):
                own = whole[level == k]
                found[own] = np.minimum(found[own], np.minimum(self.table[k][first[own]], self.table[k][last[own] + 1 - (1 << k)]))
        low_end, high_start = np.minimum(high, first * BLOCK - 1), np.maximum(low, (last + 1) * BLOCK)
        for k in range(BLOCK):
            found = np.minimum(found, np.minimum(self.shared[np.minimum(low + k, low_end)], self.shared[np.minimum(high_start + k, high)]))
        return found


def lyndon_ends(place: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the next one with a smaller suffix and the next with a larger one; the length where there is none."""
    n = len(place)
    smaller, larger = [n] * n, [n] * n
    ranks = place.tolist()
    down: list[int] = []
    up: list[int] = []
    for i, r in enumerate(ranks):
        while down and ranks[down[-1]] > r:
            smaller[down.pop()] = i
        down.append(i)
        while up and ranks[up[-1]] < r:
            larger[up.pop()] = i
        up.append(i)
    return smaller, larger


def runs(texts: list[np.ndarray], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text with a length of ``max(least, times * period)`` or more, sorted by start and period; ``times`` is 3 at least.

    The texts are arrays of word codes from 0 on.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.asarray([len(t) for t in texts], "i8")
    if not sizes.sum():
        return found
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = _marked(texts)
    ends = np.repeat(starts + sizes, sizes + 1)  # the mark behind each place's text
    here = Suffixes(codes)
    smaller, larger = lyndon_ends(here.place)
    at = np.arange(len(codes))
    places, periods = np.concatenate([at, at]), np.concatenate([smaller, larger]) - np.concatenate([at, at])
    # A run of ``times`` roots or more has one of them in its first period, which (times - 2) periods or more follow again.
    next_to = places + periods
    kept = next_to + (times - 2) * periods <= ends[places]
    places, periods, next_to = places[kept], periods[kept], next_to[kept]
    kept = codes[places] == codes[next_to]
    places, periods, next_to = places[kept], periods[kept], next_to[kept]
    right = here.extension(places, next_to)
    kept = right >= (times - 2) * periods
    places, periods, right = places[kept], periods[kept], right[kept]
    # Of the roots of a run the first is enough.
    key = places * len(codes) + periods
    kept = ~np.isin(key - periods * len(codes), key)
    places, periods, right = places[kept], periods[kept], right[kept]
    if not len(places):
        return found
    owner = np.searchsorted(starts, places, "right") - 1
    chosen = np.unique(owner)
    back = Suffixes(_marked([texts[k][::-1] for k in chosen]))
    lengths = sizes[chosen]
    shift = (np.cumsum(lengths + 1) - lengths - 1)[np.searchsorted(chosen, owner)]
    inside = places - starts[owner]
    mirrored = shift + sizes[owner] - inside  # the word before the place, seen from the end
    left = np.zeros(len(places), "i8")
    some = np.flatnonzero(inside > 0)
    left[some] = back.extension(mirrored[some] - periods[some], mirrored[some])
    total = left + periods + right
    kept = total >= np.maximum(least, times * periods)
    for k, s, length, q in sorted(set(zip(owner[kept].tolist(), (inside - left)[kept].tolist(), total[kept].tolist(), periods[kept].tolist(), strict=True)), key=lambda r: (r[0], r[1], r[3])):
        found[k].append((s, length, q))
    return found


def _marked(texts: list[np.ndarray]) -> np.ndarray:
    """The texts one after another, a mark of its own behind each; marks are smaller than all words."""
    return np.concatenate([part for k, t in enumerate(texts) for part in (t + len(texts), [k])]).astype("i8")


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds behind its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, "i8")
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


_TYPES = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period, sorted by start and period) and collapsed_text.

    Runs have at least ``least`` words and ``times`` periods. Columns that ``keep`` names are carried along as ``kept_0`` and on.
    """
    if times < 3:
        raise ValueError("runs must have at least three periods")
    names = [f"kept_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)])

    def solved(split: list[list[bytes]]) -> list[tuple]:
        flat = [w for words in split for w in words]
        codes = pd.factorize(np.array(flat, dtype=object))[0].astype("i8") if flat else np.zeros(0, "i8")
        cuts = np.cumsum([len(words) for words in split])[:-1]
        out = []
        for words, found in zip(split, runs(np.split(codes, cuts), least, times), strict=True):
            out.append((len(words), [{"start": s, "length": n, "period": q} for s, n, q in found], collapsed(words, found).decode()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, n, split = 0, 0, []
            for row, data in enumerate(batch.column("data")):
                words = data.as_py().split()  # at the six ASCII white spaces
                if split and n + len(words) > BATCH_WORDS:
                    yield _with(batch.slice(begun, row - begun), solved(split))
                    begun, n, split = row, 0, []
                split.append(words)
                n += len(words)
            yield _with(batch.slice(begun), solved(split))

    def _with(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
        made = [pa.array(v, t) for v, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *(batch.column(k) for k in names)], names=["doc_id", "n_words", "runs", "collapsed_text", *names])

    kinds = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in names)
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string{kinds}")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with words of every tenth text (by the CRC-32 of its id) repeated from a place on, so that it ends in a run.

    With h the checksum and g = h // 10: texts of n > 0 words with h % 10 = 0 have their word i >= a = g % n replaced
    by word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8). Their words are then joined by one space; rows without an id stay.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    own = {c: F.col(f"own_{k}") for k, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)], F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("w").cast("long")
    placed = named.withColumn("a", F.when(n > 0, F.pmod("g", n)))
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (F.pmod("g", F.lit(8)) + 3)).cast("long"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), "p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", source(i))), " ")
    return placed.select(*[(F.when(n > 0, repeated).otherwise(x) if c == text_col else x).alias(c) for c, x in own.items()])


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest one, and SHA-256 of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    exponent = F.floor(length * 1000 / F.col("best.period")).cast("long")
    return shown.select("doc_id", "n_runs", "best.start", length.alias("length"), "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
