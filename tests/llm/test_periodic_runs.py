"""Periodic runs of words: against brute force, on whole tables and on messy ones."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np

from riskloom.llm import periodic_runs as R
from riskloom.llm import queries


def brute_runs(t, least=6, times=4):
    """All (start, length, least period) by comparing each word with the one q further, for every q."""
    found = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    out = [(s, n, q) for (s, n), q in found.items() if not any(all(t[k] == t[k + p] for k in range(s, s + n - p)) for p in range(1, q))]
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shape = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shape, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_runs_equal_brute_force():
    random.seed(7)
    for _ in range(150):
        texts = []
        for _ in range(random.randint(1, 6)):
            k = random.randint(1, 4)
            t = [random.randrange(k) for _ in range(random.randint(0, 60))]
            for _ in range(random.randint(0, 2)):
                root = [random.randrange(k) for _ in range(random.randint(1, 7))]
                at = random.randint(0, len(t))
                t[at:at] = (root * 9)[: random.randint(1, 60)]
            texts.append(t)
        assert R.runs([np.asarray(t, "i8") for t in texts], 6, 4) == [brute_runs(t) for t in texts]
        assert R.runs([np.asarray(t, "i8") for t in texts], 1, 3) == [brute_runs(t, 1, 3) for t in texts]


def test_extensions_over_many_blocks():
    rng = np.random.default_rng(3)
    codes = np.append(np.tile(rng.integers(1, 3, 97), 30), 0)
    s = R.Suffixes(codes)
    pairs = rng.integers(0, len(codes) - 1, (400, 2))
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    want = []
    for i, j in pairs.tolist():
        k = 0
        while max(i, j) + k < len(codes) and codes[i + k] == codes[j + k]:
            k += 1
        want.append(k)
    assert s.extension(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_query_equals_brute_force_on_the_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()}
    assert got == {brute_row(r["doc_id"], r["text"]) for r in rows}
    assert any(r[1] for r in got)


def test_messy_and_empty_tables(spark, messy, nothing):
    more = messy.union(messy.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"`{c}`" for c in messy.columns[5:]]))
    found = R.digests(R.periodic_runs(R.with_planted_runs(more)))
    got = collections.Counter(tuple(r) for r in found.collect())
    texts = [r for r in messy.select("doc_id", "text").collect() if len(r["text"] or "") < 50_000]
    want = collections.Counter(brute_row(r["doc_id"], r["text"]) for r in [*texts, *texts])
    assert not want - got and sum(got.values()) == more.count()
    assert R.digests(R.periodic_runs(R.with_planted_runs(nothing))).count() == 0
    kept = R.periodic_runs(more, keep=("start",)).collect()
    assert {r["kept_0"] for r in kept} == {"start"}
    assert [r["runs"] for r in kept if r["doc_id"] == 9][0] == [(0, 40000, 2)]


def test_collapsed_texts_have_no_runs_of_their_own_period(spark):
    df = spark.createDataFrame([(1, "a b " * 9 + "c c c c c c d"), (2, "x " * 5)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in R.periodic_runs(df).collect()}
    assert rows[1]["collapsed_text"] == "a b c d" and [tuple(x) for x in rows[1]["runs"]] == [(0, 18, 2), (18, 6, 1)]
    assert rows[2]["collapsed_text"] == "x x x x x" and rows[2]["runs"] == []
