"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised where they lie (the texts are never shuffled), cut into pieces of at most
``capacity`` tokens, and the pieces' lengths alone are dealt into randomised groups of bounded
size. Each group is packed on its own by first-fit decreasing: a tournament tree whose inner nodes
hold the largest room below them finds the first bin with enough room in O(log bins).

Defined results: a null or empty text has only the end token; repeated rows are packed each on
their own; an empty table gives no pieces; other columns of the input are ignored. Rows without an
id, and rows of one id, are dealt over all groups like any others.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut

#: A worker forgets its words, or its stems, beyond this many, so its memory stays bounded.
MEMO_WORDS = 1_000_000

#: Texts whose unseen words are looked up together.
TOGETHER = 128

#: What a tokenizer file must say for texts to be encoded word by word and words by stem: white space separates, letters are
#: lower-cased and cut from marks. Fixed values of that form of file; any other file encodes whole texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

#: A stem of plain letters and the marks behind it: the tokenizer always cuts between the two.
STEM = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*#$%&|]*)")

#: Parts words that are encoded in one call; words that hold it themselves are encoded alone.
MARK = "\x01"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of whole texts, from bounded memos of blank-separated words and of their stems.

    The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
    words one after another; special tokens hold no white space and are found inside words. A file
    that says otherwise encodes whole texts. Ids are kept as little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        spec = json.loads(self.tokenizer.to_str())
        normal, cuts = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = normal.get("normalizers") == NORMALIZER and cuts.get("pretokenizers", [None])[0] == SPLIT and not any(re.search(r"\s", t) or STEM.fullmatch(t) for t in special)
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {"": b""}
        if self.by_word:
            (self.mark,) = self._ids(MARK)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words without white space, from one call of the tokenizer."""
        ids = np.asarray(self._ids(f" {MARK} ".join(words)), dtype="<u4")
        cuts = np.flatnonzero(ids == self.mark)
        data = ids.tobytes()
        starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(data)]
        return (data[s:e] for s, e in zip(starts, ends, strict=True))

    def _learn(self, missing: set[str]) -> None:
        split = {w: m.groups() for w in missing if (m := STEM.fullmatch(w))}
        parts = {x for stem, tail in split.values() for x in (stem.lower(), tail)}
        if len(self.stems) > self.limit:
            self.stems = {"": b""}
        if new := list(parts.difference(self.stems)):
            self.stems.update(zip(new, self._encode(new), strict=True))
        for word in missing:
            if word in split:
                stem, tail = split[word]
                self.words[word] = self.stems[stem.lower()] + self.stems[tail]
            else:
                self.words[word] = np.asarray(self._ids(word), dtype="<u4").tobytes()

    def forget(self) -> None:
        """Let go of all words and stems."""
        self.words, self.stems = {"": b""}, {"": b""}

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.by_word:
            return (np.asarray(self._ids(t), dtype="<u4").tobytes() for t in texts)
        split = [text.replace("\n", " ").split(" ") for text in texts]
        if missing := set().union(*split).difference(self.words):
            if len(self.words) + len(missing) > self.limit:
                self.words = {"": b""}
                missing = set().union(*split) - {""}
            self._learn(missing)
        return (b"".join(map(self.words.__getitem__, words)) for words in split)

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))


@lru_cache(maxsize=1)
def word_ids(path: str, limit: int = MEMO_WORDS) -> WordIds:
    """One memo per worker process, kept from task to task."""
    return WordIds(path, limit)


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, memo_words: int = MEMO_WORDS, keep_memo: bool = True) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document, the end id included.

    ``keep_ids`` adds the ids themselves as array<int>. Without ``keep_memo`` a worker forgets its words at the end of each
    task, so that they take no memory from later stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces_of(batches)
        finally:
            if not keep_memo:
                word_ids(tokenizer, memo_words).forget()

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, memo_words)
        end = np.asarray([end_id], dtype="<u4").tobytes()

        def each(texts: pa.Array) -> Iterator[bytes]:
            for k in range(0, len(texts), TOGETHER):
                yield from ids_of.many([t or "" for t in texts.slice(k, TOGETHER).to_pylist()])

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids)}
            for doc, ids in zip(batch.column(0).to_pylist(), each(batch.column(1)), strict=True):
                data = ids + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                    for k, v in zip(out, row, strict=False):
                        out[k].append(v)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(piece, "<u4").astype("i4"))
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items go longest first (ties in the order given), each into the first bin with room."""
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(n, "i8"), np.zeros(n, "i8")
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 16_384, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, start, length and more columns).

    Groups are drawn by a seeded hash of a key that each piece gets once, and hold about ``group_pieces``
    pieces whatever the size of the input and however often an id repeats, so no task grows with it. With
    more than one group, which pieces share one follows the partitions of the input. Lengths must lie
    between 0 and ``capacity``.
    """
    names = pieces.columns
    pieces = cut(pieces.withColumn("pack_key", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in ("doc_id", "start", "length", "pack_key")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        sequence = (group.column("pack_group").to_numpy().astype("i8") << 32) + bins
        return group.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names) + ", sequence_id long, offset long"
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "pack_key"), F.lit(groups)))
    return grouped.groupBy("pack_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, **names) -> DataFrame:
    """Tokenise whole documents and pack all their pieces: one row per piece."""
    return pack(tokenised_pieces(docs, tokenizer, end_id, capacity, **names), capacity)
