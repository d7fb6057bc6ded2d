"""Byte-level BPE in two tiers.

Tier one is a minimal perfect hash over the vocabulary (hash and displace): a whole pre-token that
is itself a vocabulary entry is resolved by one probe and one comparison. Tier two merges the rest:
the bytes form a doubly linked list and a heap holds the candidate merges by (rank, position).

The hash is built once on the driver and broadcast; its size is that of the vocabulary file and
does not grow with the input. Texts are encoded where they lie, without a shuffle.

Defined results: a null text is the empty text (no tokens); every byte decodes back; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A worker forgets its pre-tokens beyond this many, so its memory stays bounded.
MEMO_PRETOKENS = 300_000


class PerfectHash:
    """Minimal perfect hash of a fixed key set: n keys, n slots.

    A key's 64-bit hash gives its bucket; mixed with the bucket's displacement it gives its slot.
    Buckets are placed largest first, each with the least displacement that fits; a bucket of one
    key takes a free slot, kept as a negative displacement.
    """

    MASK = (1 << 64) - 1
    STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.seed = 0
        while not self._build(keys):
            self.seed += 1

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), "u8", len(keys))

    def _build(self, keys: list[bytes]) -> bool:
        h = self.hashes(keys)
        self.displacement = np.zeros(self.buckets, "i8")
        self.slot_key = np.full(max(1, self.n), -1, "i8")
        bucket = (h % np.uint64(self.buckets)).astype("i8")
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        by_size = np.argsort(-np.diff(starts), kind="stable").tolist()
        free = None
        for k in by_size:
            own = order[starts[k] : starts[k + 1]].tolist()
            if not own:
                break
            if len(own) == 1:
                free = iter(np.flatnonzero(self.slot_key < 0).tolist()) if free is None else free
                slots = [next(free)]
                self.displacement[k] = -1 - slots[0]
            else:
                hs = [int(h[i]) for i in own]
                for d in range(100_000):
                    slots = [((((x ^ (d * self.STEP & self.MASK)) * self.MIX) & self.MASK) >> 32) % self.n for x in hs]
                    if len(set(slots)) == len(slots) and all(self.slot_key[s] < 0 for s in slots):
                        break
                else:
                    return False
                self.displacement[k] = d
            for s, i in zip(slots, own, strict=True):
                self.slot_key[s] = i
        return True

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each key the only entry it can be; the caller compares. -1 if there are no entries."""
        if not self.n:
            return np.full(len(keys), -1, "i8")
        h = self.hashes(keys)
        d = self.displacement[(h % np.uint64(self.buckets)).astype("i8")]
        mixed = ((h ^ (d.astype("u8") * np.uint64(self.STEP))) * np.uint64(self.MIX)) >> np.uint64(32)
        return self.slot_key[np.where(d < 0, -1 - d, (mixed % np.uint64(self.n)).astype("i8"))]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word outside the vocabulary: a heap of merges over linked bytes."""
    n = len(word)
    after = list(range(1, n + 1))  # start of the part behind the part that starts here
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, end = heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue
        alive[j] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := get(word[i : after[end]])) is not None:
                heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := get(word[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = MEMO_PRETOKENS):
        self.ranks, self.pattern, self.limit = ranks, pattern, limit
        self.entries = sorted(ranks, key=ranks.__getitem__)
        self.hash = PerfectHash(self.entries)
        self._open()

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ranks", "pattern", "limit", "entries", "hash")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        import regex

        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}

    def _resolve(self, words: list[str]) -> None:
        keys = [w.encode("utf-8", "surrogatepass") for w in words]
        for word, key, k in zip(words, keys, self.hash.candidates(keys).tolist(), strict=True):
            hit = k >= 0 and self.entries[k] == key
            self.memo[word] = (self.ranks[key],) if hit else tuple(merge_bytes(key, self.ranks))

    def encode(self, text: str) -> list[int]:
        words = self.find(text)
        missing = list(set(words).difference(self.memo))
        if missing:
            if len(self.memo) + len(missing) > self.limit:
                self.memo = {}
                missing = list(set(words))
            self._resolve(missing)
        return list(chain.from_iterable(map(self.memo.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids and the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        name = {rank: str(rank) for rank in bpe.ranks.values()}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                decoded = bpe.decode(ids)
                row = (doc, len(ids), hashlib.sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, ids, decoded.decode("utf-8", "replace")) if keep_ids else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * (6 if keep_ids else 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=False)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
