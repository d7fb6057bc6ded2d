"""Tokens, packing, rules, classifier, shards: against libraries, brute force and on messy tables."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, line_crf, packing, sharding, weak_rules

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = [b"k%d" % i for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert h.candidates(keys).tolist() == list(range(5000))
    assert sorted(h.slot_key.tolist()) == list(range(5000))
    assert byte_bpe.PerfectHash([]).candidates([b"x"]).tolist() == [-1]


def test_byte_bpe_equals_the_library(spark, messy, nothing):
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = byte_bpe.encoded(messy, RANKS, P.PATTERN).collect()
    texts = [r["text"] or "" for r in messy.collect()]
    key = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert collections.Counter(r["ids_sha256"] for r in rows) == collections.Counter(key(want.encode_ordinary(t)) for t in texts)
    assert collections.Counter(r["decoded"] for r in rows) == collections.Counter(texts)
    assert byte_bpe.encoded(nothing, RANKS, P.PATTERN).count() == 0


def test_pieces_hold_every_id_once_and_sequences_fit(spark, messy, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    pieces = packing.pack(packing.tokenised_pieces(messy, WORDS, keep_ids=True, capacity=64), 64, group_pieces=50).collect()
    got = collections.defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) <= 64 and p["ids_crc32"] == zlib.crc32(np.asarray(p["ids"], "<u4").tobytes())
        got[p["doc_id"]].append(p)
    for r in messy.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted(got[r["doc_id"]], key=lambda p: p["start"])
        copies = sum(x["doc_id"] == r["doc_id"] for x in messy.collect())
        assert sum(p["length"] for p in own) == copies * len(ids)
        if copies == 1:
            assert list(itertools.chain.from_iterable(p["ids"] for p in own)) == ids
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_workers_of_the_pipeline_forget_their_words(spark, messy):
    from riskloom.llm.common import importable

    importable(spark)

    def remembered(batches):
        for batch in batches:
            memo = packing.word_ids(WORDS, 12_345)
            yield pa.RecordBatch.from_pydict({"n": [len(memo.words) + len(memo.stems)]})

    packing.pack_documents(messy.repartition(4), WORDS, memo_words=12_345, keep_memo=False).count()
    assert {r["n"] for r in spark.range(8).repartition(4).mapInArrow(remembered, "n long").collect()} == {2}  # the empty text alone


def test_rows_without_an_id_are_dealt_over_all_groups(spark):
    """Equal rows, and rows without an id, fall into no group of more than its bound."""
    pieces = spark.range(60_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0L AS start", "1 + id % 2 AS length")
    rows = packing.pack(pieces, 64, group_pieces=4096).groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g"), "sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["n"] for r in rows) == 90_000 and max(r["n"] for r in rows) <= 64
    per = collections.Counter()
    for r in rows:
        per[r["g"]] += r["k"]
    assert len(per) == 15 and max(per.values()) < 1.2 * 4096


def test_word_ids_equal_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    texts = ["hi <|endoftext|> there<|endoftext|>", "<|startoftext|>A<|endoftext|>.", "<|endoftext |>|<|ENDOFTEXT|>", "it's I'LL naïve Éa\u0301 \u00a0x\u0085y\x1cz a\u0308. \u0308 İ", "x\ty\r\nz  ..,, a.b! 12a ***", "\x01 a \x01b", ""]
    t = Tokenizer.from_file(WORDS)
    want = [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert np.frombuffer(want[0], "<u4").tolist() == [1883, 49407, 997, 49407]
    ids = packing.WordIds(WORDS)
    assert ids.by_word and list(ids.many(texts)) == want and list(map(ids, texts)) == want
    spec = json.loads(t.to_str())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # keeps capitals
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other, plain = packing.WordIds(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not other.by_word and list(other.many(texts)) == [np.asarray(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_first_fit_decreasing_equals_the_plain_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        assert bins[i] == k and offsets[i] == 100 - room[k]
        room[k] -= lengths[i]


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g, n in collections.Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_statistics_equal_brute_force(spark, small, messy, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text"))
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]].add(brute_statistics(r["text"] or ""))
    for r in weak_rules.judged(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) in texts[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert weak_rules.judged(nothing).count() == 0
    assert weak_rules.kept_documents(messy).columns == messy.columns


def test_kept_documents_with_many_rejected_texts(spark, small, messy, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text")).union(spark.range(300).selectExpr("id", "CAST(NULL AS STRING)"))
    want = collections.Counter(map(tuple, weak_rules.kept_documents(docs).collect()))
    monkeypatch.setattr(weak_rules, "small", lambda side: False)
    assert want and collections.Counter(map(tuple, weak_rules.kept_documents(docs).collect())) == want
    assert sum(want.values()) == weak_rules.judged(docs).filter("kept").count()


def test_rules_learn_their_accuracies():
    good, bad = (1,) * 5, (1, 0, 0, 0, 1)
    post = weak_rules.fit({good: 900, bad: 80, (1, 1, 1, 1, -1): 20})
    assert post[good] > 0.9 and post[bad] < 0.1 and weak_rules.fit({}) == {}


def test_expectation_maximisation_equals_plain_loops_over_documents():
    rng = np.random.default_rng(3)
    good = rng.random(6000) < 0.7
    right = np.where(good[:, None], [0.95, 0.9, 0.97, 0.8], [0.7, 0.6, 0.5, 0.65])
    agree, voted = rng.random(right.shape) < right, rng.random(right.shape) < 0.9
    votes = np.where(voted, np.where(agree, good[:, None], ~good[:, None]).astype(int), weak_rules.ABSTAIN)
    got = weak_rules.fit(collections.Counter(map(tuple, votes.tolist())), rounds=25)
    prior, rates = 0.8, np.tile([[0.2], [0.99]], 4)  # rates[class, rule]: votes that agree with the class

    def posterior():
        fit = []
        for c in (0, 1):
            p = np.where(votes == c, rates[c], np.where(votes == 1 - c, 1 - rates[c], 1.0)).prod(axis=1)
            fit.append(p * (prior if c else 1 - prior))
        return fit[1] / (fit[0] + fit[1])

    for _ in range(25):
        post = posterior()
        prior = np.clip((post.sum() + 4) / (len(post) + 5), 0.5, 0.99)
        for c in (0, 1):
            w = (post if c else 1 - post)[:, None]
            rates[c] = np.clip(((w * (votes == c)).sum(0) + 9) / ((w * (votes >= 0)).sum(0) + 10), 0.5 if c else 0.05, 0.999)
    want = posterior()
    assert all(abs(got[tuple(v)] - p) < 1e-6 for v, p in zip(votes.tolist(), want.tolist(), strict=True))
    assert ((want >= 0.5) == good).mean() > 0.85


def test_rules_agree_with_labels_they_never_saw(spark, small):
    rows = weak_rules.judged(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.95


def test_no_python_in_native_plans(spark, small, messy):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (weak_rules.judged(docs), weak_rules.kept_documents(docs), sharding.sharded_documents(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts, score, moves = np.array([1, 3, 2, 4]), rng.normal(size=10), rng.normal(size=(2, 2))
    p, expected, log_z = line_crf.marginals(score, counts, moves)
    start, want, pairs, total = 0, [], np.zeros((2, 2)), 0.0
    for n in counts:
        weight = {y: np.exp(sum(score[start + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        total += np.log(z)
        want += [sum(v for y, v in weight.items() if y[i]) / z for i in range(n)]
        for y, v in weight.items():
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += v / z
        start += n
    assert np.allclose(p, want) and np.allclose(expected, pairs) and np.isclose(log_z, total)


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = line_crf.scored(docs, line_crf.fitted(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_a_kept_text_goes_to_the_workers_once(spark, messy):
    model = line_crf.LineCrf().fit(np.zeros((0, line_crf.FEATURES)), np.zeros(0, "i8"), np.zeros(0, "i8"))
    df = line_crf.scored(messy, model, keep=("doc_id", "text", "lang"))
    sent = df._jdf.queryExecution().analyzed().child().output().mkString(" ")
    assert "kept_0" in sent and "kept_1" not in sent and "kept_2" in sent
    assert sorted(map(str, (r["kept_1"] for r in df.collect()))) == sorted(map(str, (r["text"] for r in messy.collect())))


def test_classifier_on_messy_tables(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 0), (5, 1), (6, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = line_crf.fitted(messy, labels)
    rows = line_crf.scored(messy, model, keep=("text", "score")).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if not (r["kept_0"] or "").strip())
    assert line_crf.scored(nothing, model).count() == 0
    none = line_crf.fitted(messy, labels.filter("false"))
    assert {r["score"] for r in line_crf.scored(messy, none).collect()} == {0.0, 0.5}


@pytest.mark.parametrize("bucket_rows", [5, 4096])
def test_shards_match_the_mixture(spark, small, bucket_rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    placed = sharding.interleaved_shards(docs, ["doc_id", "source"], "doc_id", "source", 7, bucket_rows=bucket_rows).collect()
    assert len(placed) == docs.count()
    by = collections.defaultdict(list)
    for r in placed:
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    share = collections.Counter(r["source"] for r in placed)
    for v in by.values():
        for s, n in collections.Counter(r["source"] for r in v).items():
            assert abs(n - share[s] * len(v) / len(placed)) <= 2


def test_shards_do_not_depend_on_the_number_of_buckets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = [sharding.interleaved_shards(docs, ["doc_id"], "doc_id", "source", 7, bucket_rows=n).sort("doc_id").collect() for n in (3, 50, 4096)]
    assert found[0] == found[1] == found[2]


def test_shards_of_messy_tables(spark, messy, nothing):
    rows = sharding.sharded_documents(messy, 3).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in messy.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert collections.Counter((r["shard"], r["slot"]) for r in rows) == collections.Counter((s, k) for s in range(3) for k in range(4))
    assert sharding.sharded_documents(nothing).count() == 0
