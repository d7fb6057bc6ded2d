"""SimHash, suffix array, top-k, archives, pages and the pipeline: against brute force and on messy tables."""

import base64
import collections
import hashlib
import io
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from riskloom.llm import components, simhash_trie, style_tree, suffix_dedup, topk_threshold, warc_zip


def brute_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > len(shingles)) << b for b, v in enumerate(votes))


def brute_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.asarray(fps, "u8")
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= budget), strict=True):
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark, small, messy, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = simhash_trie.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    fps = [brute_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, brute_components(fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want
    got = simhash_trie.near_duplicates(messy).collect()
    assert len(got) == 12 and {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert simhash_trie.near_duplicates(nothing).count() == 0
    kept = simhash_trie.without_near_duplicates(messy)
    assert kept.columns == messy.columns and len({r["doc_id"] for r in kept.collect()}) == kept.count()


@pytest.mark.parametrize("group_rows", [5, 20_000])
def test_trie_finds_every_link_of_dense_clusters(spark, group_rows):
    rng = np.random.default_rng(7)
    fps = set()
    for centre in rng.integers(0, 2**63, 6, dtype="u8"):
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps | set(map(int, rng.integers(0, 2**63, 100, dtype="u8"))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    found = {r["node"]: r["component"] for r in components.components(simhash_trie.near_links(classes, 4, group_rows), "a", "b").collect()}
    want = brute_components(fps)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100)


def test_components_deal_hubs_over_tasks(spark):
    edges = [(300, k) for k in range(500)] + [(k, k + 1000) for k in range(0, 500, 7)] + [(2000, 2001)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", hot_rows=20).collect()}
    assert got == dict.fromkeys({x for e in edges[:-1] for x in e}, 0) | {2000: 2000, 2001: 2000}


def test_many_rows_of_one_fingerprint_and_no_id(spark):
    fps = spark.range(45_000).select(F.expr("IF(id < 40000, NULL, id)").alias("doc_id"), F.expr("IF(id < 44000, 5L, id * 7919 * 104729)").alias("fp")).checkpoint()
    got = simhash_trie.grouped(fps).groupBy("component_id").count().collect()
    assert sum(r["count"] for r in got) == 45_000 and {r["component_id"]: r["count"] for r in got}[40_000] >= 44_000


def brute_removed(docs, least):
    seen = collections.Counter(x[i : i + least] for x in docs for i in range(len(x) - least + 1))
    out = []
    for x in docs:
        gone = np.zeros(len(x) + 1, "i4")
        for i in range(len(x) - least + 1):
            if seen[x[i : i + least]] > 1:
                gone[i] += 1
                gone[i + least] -= 1
        gone = np.cumsum(gone)[: len(x)] > 0
        rest = bytes(np.frombuffer(x, "u1")[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype("i4")))) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("least,group_rows", [(400, 20_000), (100, 20_000), (100, 3), (400, 8)])
def test_repeated_passages_equal_brute_force(spark, least, group_rows):
    import random

    random.seed(5)
    letters = "abcdefgh éß"
    base = "".join(random.choice(letters) for _ in range(900))
    docs = []
    for _ in range(50):
        x = list(base)
        for _ in range(random.randrange(4)):
            x[random.randrange(len(x))] = random.choice("XYZ")
        docs.append("".join(random.choice(letters) for _ in range(random.randrange(50))) + "".join(x)[random.randrange(300) :])
    docs += ["a" * 1000, "ab" * 300, None, "", base * 2, base[:120], docs[0]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = suffix_dedup.deduplicated(df, least, group_rows=group_rows).orderBy("doc_id").collect()
    want = brute_removed([(x or "").encode() for x in docs], least)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == want
    assert all(sum(s["e"] - s["s"] for s in r["spans"]) == r["n_removed"] for r in rows)


def test_passages_of_messy_tables(spark, messy, nothing):
    rows = suffix_dedup.deduplicated(messy, 400, keep=("spans", "key")).collect()
    want = brute_removed([(r["text"] or "").encode() for r in messy.collect()], 400)
    assert collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == collections.Counter(want)
    assert suffix_dedup.deduplicated(nothing, 400).count() == 0


def test_long_texts_are_gone_through_in_segments():
    data = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype="u1"))
    whole = [(a, s) for a, lo, hi in suffix_dedup.anchors(data, 100) for s in range(lo, hi + 1)]
    for segment in (1, 57, 1000, 4901, 4902):
        assert [(a, s) for a, lo, hi in suffix_dedup.anchors(data, 100, segment) for s in range(lo, hi + 1)] == whole
    assert [s for _, s in whole] == list(range(4901))


def test_removal_of_the_tables_equals_brute_force(spark, small):
    from riskloom.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op8_suffix_dedup(spark, small).orderBy("doc_id").collect()
    want = brute_removed([(r["text"] or "").encode() for r in docs], 400)
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == want
    assert all(r["n_removed"] or r["text"] == (d["text"] or "") for r, d in zip(rows, docs, strict=True)) and any(r["n_removed"] for r in rows)


def test_deep_shallow_sorts():
    import random

    random.seed(3)
    for _ in range(100):
        stem = bytes(random.choice(b"ab") for _ in range(100))
        texts = [(stem[: random.randrange(60, 100)] if random.random() < 0.7 else b"") + bytes(random.choice(b"ab\0") for _ in range(random.randrange(30))) for _ in range(random.choice([1, 2, 40]))]
        assert [texts[i] for i in suffix_dedup.deep_shallow(texts)] == sorted(texts)


@pytest.mark.parametrize("block_rows", [64, None])
def test_top_k_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 6)), 1)
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(500, None), (501, [1.0, None, 0, 0, 0, 0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [0.0] * 6), (504, []), (505, [1.0])]
    rows = [(i, v and [None if e is None else float(e) for e in v] if v != [] else []) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk_threshold.quantised(df)
    got = topk_threshold.top_k(q, q.filter("vec_id % 50 = 0"), 10, block_rows=block_rows, query_rows=3).collect()
    v = np.floor(1024 * x.astype("f4").astype("f8")).astype("i8")
    for query in range(0, 400, 50):
        s = v @ v[query]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != query][:10]
        own = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [(r["rank"], r["vec_id"], r["score"]) for r in own] == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    assert topk_threshold.top_k(q.filter("false"), q.filter("false")).count() == 0


def brute_top_k(ids, x, query_ids, queries, k):
    out = []
    for q, v in zip(query_ids.tolist(), queries, strict=True):
        s = x @ v
        out += [(q, int(ids[j]), int(s[j])) for j in [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]]
    return sorted(out)


@pytest.mark.parametrize("skew", [0.0, 0.5, 1.0])
def test_threshold_stops_early_where_dimensions_are_skewed(skew):
    rng = np.random.default_rng(0)
    x = np.floor(1024 * rng.normal(size=(4000, 16)) * 2.0 ** (-skew * np.arange(16))).astype("i8")
    x[100:140] = x[100]  # ties
    ids, q = np.arange(4000), np.arange(0, 4000, 50)
    block = topk_threshold.Block(ids, x)
    found = sorted(block.top_k(q, x[q], 10))
    assert found == brute_top_k(ids, x, q, x[q], 10)
    if skew:
        assert block.scored / (len(ids) * len(q)) < 0.5
    floor = np.array([min(s for i, _, s in found if i == n) for n in q])
    carried = topk_threshold.Block(ids, x)
    assert sorted(carried.top_k(q, x[q], 10, floor)) == found
    assert carried.scored <= block.scored


def test_threshold_reads_only_the_tops_it_needs():
    x = np.zeros((4000, 2), "i8")
    x[:, 0] = np.arange(4000)
    block = topk_threshold.Block(np.arange(4000), x)
    assert [o[1] for o in block.top_k(np.array([-1]), np.array([[1, 0]]), 5)] == [3999, 3998, 3997, 3996, 3995]
    assert block.scored < 200


def test_top_k_with_repeated_ids_and_few_candidates(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 0.5]), (2, [3.0, -1.0]), (3, [0.0, 0.0])]
    q = topk_threshold.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "0 AS dim", "1 AS cell", "2 AS floor"))
    got = topk_threshold.top_k(q, q.filter("vec_id = 3"), 10, block_rows=2).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 2, 0)]


def test_archives_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(10_001, "u\nx", "same"), (10_002, None, "same"), (10_003, "http://é/", None), (10_004, "b", ""), (None, "c", "same")], "page_id long, url string, html string")
    rows = warc_zip.round_trip(pages.union(extra)).collect()
    best = {}
    for r in pages.union(extra).collect():
        h = (r["html"] or "").encode()
        best[h] = max(best.get(h, -1), -1 if r["page_id"] is None else r["page_id"])
    want = collections.Counter()
    for r in pages.union(extra).collect():
        h = (r["html"] or "").encode()
        own = r["page_id"] == best[h]
        want[(r["page_id"], len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if own else "revisit", None if own else best[h])] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert warc_zip.round_trip(extra.filter("false")).count() == 0
    big = warc_zip.round_trip(extra, min_bytes=5).collect()
    assert {r["record_type"] for r in big if r["payload_bytes"] == 4} == {"response"}


def test_directories_with_and_without_zip64(monkeypatch, tmp_path):
    records = [(k, warc_zip.record(k, "u", b"x" * k, None, False)) for k in range(20)]
    plain = warc_zip.zipped(records)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = warc_zip.zipped(records)
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in plain
    for data in (plain, wide, plain):
        found = warc_zip.members(io.BytesIO(data), len(data))
        start, length, method = found[warc_zip.DATA]
        assert method == 0 and [n for _, n in warc_zip._scan(io.BytesIO(data), start, length)] == [len(d) for _, d in records]
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"nothing"), 7)
    assert warc_zip.parse(zlib.decompress(records[3][1], wbits=31))["payload"] == b"xxx"


def test_archive_without_an_index_is_scanned(spark, tmp_path):
    records = [warc_zip.record(k, "u", b"p%d" % k, None, False) for k in range(5)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc_zip.DATA, b"".join(records))
    rows = warc_zip.read_records(warc_zip.locate(spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "path string"))).collect()
    assert sorted((r["page_id"], bytes(r["payload"])) for r in rows) == [(k, b"p%d" % k) for k in range(5)]


def test_members_of_any_name_and_faulty_archives():
    texts = [b"p%d" % k * 50_000 for k in range(4)]
    records = [warc_zip.record(k, "u", x, None, False) for k, x in enumerate(texts)]
    plain = b"".join(zlib.decompress(r, wbits=31) for r in records[2:])

    def found(*files, method=zipfile.ZIP_STORED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files:
                z.writestr(name, data, method)
        data = out.getvalue()
        raw = [data[o : o + n] for o, n in warc_zip.ranges(io.BytesIO(data), len(data), "a.zip")]
        return [warc_zip.parse(zlib.decompress(r, wbits=31) if r[:2] == b"\x1f\x8b" else r)["payload"] for r in raw]

    index = f'com,a)/ 2024 {{"filename": "x.warc.gz", "offset": "{len(records[0])}", "length": "{len(records[1])}"}}'
    assert found(("archive/x.warc.gz", b"".join(records[:2])), ("archive/y.warc", plain)) == texts
    assert found(("archive/x.warc.gz", b"".join(records[:2])), ("archive/y.warc", plain), ("indexes/i.cdxj", index)) == [texts[1], *texts[2:]]
    for files in ([("readme", b"x")], [("archive/y.warc", plain), ("i.cdxj", index)], [("x.warc.gz", records[0][:-9])], [("y.warc", plain[:9])]):
        with pytest.raises(ValueError):
            found(*files)
    with pytest.raises(ValueError):
        found(("x.warc.gz", b"".join(records)), method=zipfile.ZIP_DEFLATED)


def test_common_payloads_are_dealt_out(spark, monkeypatch):
    from riskloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = [(i, "u", "same", 1, "x") for i in range(300)] + [(300 + i, "u", f"own {i}", 1, "x") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n long, digest string").repartition(7)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc_zip.round_trip(pages).collect()}
    assert got == {i: ("revisit", 299) for i in range(299)} | {i: ("response", None) for i in range(299, 350)}
    large, side = spark.range(1000).selectExpr("id", "IF(id < 700, 0, id) AS k"), spark.createDataFrame([(0, 700), (800, 1)], "k long, n long")
    dealt = common.spread_to(large, side, ["k"], hot_rows=100)
    assert dealt.count() == 701 and dealt.columns == ["k", "id", "n"]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>A &amp; b</h1><p><b>one  two<br><p>three&nbsp;four<p>five</p><form>f</form><aside>s</aside><div class="share">x</div></article>
<section id="comments"><p>me too</p></section><div class="ad">buy</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_one_page():
    assert style_tree.main_text(style_tree.parsed(PAGE), set()) == "A & b\none two\nthree four\nfive"
    assert style_tree.main_text(style_tree.parsed("<p>a<p>b <i>c</i>d<div>e"), set()) == "a\nb cd\ne"
    assert style_tree.main_text(style_tree.parsed(""), set()) == ""


def test_repeated_branches_of_a_site_are_removed(spark):
    body = "<body><div class='x'><p>Read our offers today</p></div><div class='y'><p>%s</p><p>tail %d of the page</p></div></body>"
    pages = [(i, f"http://h.com/{i}", body % (f"story{i} " * 40, i)) for i in range(12)] + [(100, "http://other.com/", body % ("only page " * 20, 1)), (101, None, None), (102, "http://h.com/e", ""), (103, "http://h.com/b", "<div><p>a<b>c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in style_tree.main_texts(df.withColumn("places", df.url).withColumn("host", df.url)).collect()}
    assert got[3]["text"] == ("story3 " * 40).strip() + "\ntail 3 of the page" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"].startswith("Read our offers today\n")  # one page tells nothing about its site
    assert got[101]["text"] == got[102]["text"] == "" and got[103]["text"] == "ac"
    same = spark.createDataFrame([(i, f"http://c.com/{i}", body % ("same story " * 30, 1)) for i in range(12)], "page_id long, url string, html string")
    assert all("same story" in r["text"] for r in style_tree.main_texts(same).collect())
    assert style_tree.main_texts(df.filter("false")).count() == 0


def test_pages_of_the_tables_give_their_articles(spark, small):
    import html

    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in style_tree.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?h1>|</?p>|<br>", article)]
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_pipeline(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    start = docs
    left = [docs.count()]
    for _, stage in c.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, small).cache()
        assert docs.columns == before.columns
        left.append(docs.count())
    assert left[0] > left[1] >= left[2] >= left[3] == left[4]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in docs.collect()}
    assert not any(labels.get(i) == 0 for i in kept)
    assert kept <= {r["doc_id"] for r in start.collect()}
    packed = c.run(spark, small)
    assert {r["doc_id"] for r in packed.collect()} == kept


def test_stages_on_messy_and_empty_tables(spark, small, messy, nothing):
    import corpus_pipeline as c

    for _, stage in c.STAGES:
        out = stage(spark, messy, small)
        assert stage == c.STAGES[-1][1] or out.columns == messy.columns
        assert 0 < out.count() <= 12 or stage == c.STAGES[-1][1]
        assert stage(spark, nothing, small).count() == 0


def test_queries_equal_their_sql(spark, small, oracle):
    from riskloom.llm import queries
    from tests.compare import assert_same

    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, small), oracle, sql)


def five_word_sets(texts):
    split = [t.encode().lower().split() for t in texts]
    return [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


def jaccard_roots(texts, least=0.8):
    sets = five_word_sets(texts)
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {b""}:
            holders[x].append(i)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s or {b""} for j in holders[x] if j < i)
        for j, n in shared.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("rounds,group_rows", [(2, 20_000), (0, 20_000), (0, 4)])
def test_near_duplicate_stage_equals_exact_jaccard(spark, small, monkeypatch, rounds, group_rows):
    import random

    monkeypatch.setattr(simhash_trie, "STAR_ROUNDS", rounds)

    random.seed(11)
    docs = [" ".join(random.choice("abcdefghijklmnop") + str(random.randrange(99)) for _ in range(120)) for _ in range(12)]
    for k in range(12):
        for changed in (1, 2, 3, 6):
            w = docs[k].split()
            for i in random.sample(range(120), changed):
                w[i] = "changed"
            docs.append(" ".join(w))
    docs += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_trie.without_similar(df, group_rows=group_rows).collect()}
    assert kept == set(jaccard_roots(docs))


def test_rows_without_or_with_a_shared_id_are_told_apart(spark, small):
    import corpus_pipeline as c

    rng = np.random.default_rng(5)
    a, b, n, z = (" ".join(f"w{v}" for v in rng.integers(0, 10**6, 200)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (5, n), (5, z), (7, z), (None, "a clean text that is like no other one in this table")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kept in (simhash_trie.without_near_duplicates(df), c.near_duplicates(spark, df, small)):
        assert collections.Counter(tuple(r) for r in kept.collect()) == collections.Counter([rows[0], rows[1], rows[3], rows[4], rows[6]])


def test_a_text_without_an_id_links_others(spark):
    fps = [(3, 0), (None, 0b1111), (4, 0b11111111), (None, 1 << 40 | (1 << 20) - 1), (6, 0x5555 << 44), (None, 0x5555 << 44)]
    got = simhash_trie.grouped(spark.createDataFrame(fps, "doc_id long, fp long")).collect()
    assert collections.Counter((r["fp"], r["component_id"]) for r in got) == collections.Counter({(0, 3): 1, (15, 3): 1, (255, 3): 1, (fps[3][1], None): 1, (fps[4][1], 6): 2})


def brute_tree(pages):
    """host and place to pages, presentation and content entropy, counted in plain Python."""
    import math

    seen = collections.defaultdict(list)
    for url, html in pages:
        host = re.match("https?://([^/]*)", url)[1]
        for place, look, content, _, _ in style_tree.style_rows(style_tree.parsed(html)):
            seen[host, place].append((look, content))
    out = {}
    for key, rows in seen.items():
        entropy = [1.0 if len(rows) < 2 else -sum(n / len(rows) * math.log(n / len(rows), len(rows)) for n in collections.Counter(r[k] for r in rows).values()) for k in (0, 1)]
        out[key] = (len(rows), *entropy)
    return out


def unnamed_site(n):
    """A site whose class names tell nothing and that has no article element: banners, a menu, a box that varies a little, and stories."""
    rng = np.random.default_rng(3)
    words = lambda k: " ".join(f"w{v}" for v in rng.integers(0, 10**5, k))
    pages, stories = [], []
    for i in range(n):
        paragraphs = [words(int(rng.integers(20, 60))) for _ in range(int(rng.integers(2, 6)))]
        box = ("today it rains", "today it shines")[i % 2]
        pages.append((f"http://s.com/{i}", f"<body><div class='qa'><span>one site for all</span></div><div class='qb'><ul><li>home<li>news<li>about</ul></div><div class='qc'><p>{box}</p></div><div class='qd'><p>{'</p><p>'.join(paragraphs)}</p></div><div class='qe'>all rights kept</div></body>"))
        stories.append("\n".join(paragraphs))
    return pages, stories


def test_the_style_tree_equals_a_brute_force_tree_and_decides(spark, small):
    pages, stories = unnamed_site(40)
    tables = [(r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").filter("url IS NOT NULL AND html IS NOT NULL").collect()]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages + tables)], "page_id long, url string, html string")
    want = brute_tree(pages + tables)
    got = {(r["host"], r["place"] % (1 << 64)): (r["pages"], r["presentation"], r["content"]) for r in style_tree.style_tree(df).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    found = {r["page_id"]: r["text"] for r in style_tree.main_texts(df).collect()}
    assert [found[i] for i in range(40)] == stories
    alone = [style_tree.main_text(style_tree.parsed(h)) for _, h in pages]  # without the tree
    assert all(a != s and "one site for all" in a for a, s in zip(alone, stories, strict=True))


def test_words_that_may_name_a_topic_leave_it_to_the_tree(spark):
    page = "<body><article><p>%s</p><div class='discussion'>%s</div><div class='related'>read this too</div></article> stray</body>"
    rows = [(i, f"http://t.com/{i}", page % (f"story{i} " * 9, f"they discuss point {i} " * 3)) for i in range(12)]
    found = {r["page_id"]: r["text"] for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: ("story%d " % i * 9).strip() + "\n" + (f"they discuss point {i} " * 3).strip() for i in range(12)}


def test_stub_pages_leave_a_sites_boilerplate_removed(spark):
    body = "<body><div class='x'><p>Read our offers today</p></div><div class='y'><p>%s</p></div></body>"
    pages = [(i, f"http://h.com/{i}", body % (f"story{i} " * 40)) for i in range(12)] + [(i, f"http://h.com/{i}", body % "") for i in (20, 21)]
    got = {r["page_id"]: r["text"] for r in style_tree.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: (f"story{i} " * 40).strip() for i in range(12)} | {20: "", 21: ""}


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='no-sidebar'", "div class='post tag-news'", "div class='page comments-open'", "div class='widget'", "form"])
def test_named_wrappers_keep_what_the_page_is_about(wrapper):
    text = "the story itself goes on and on " * 9
    closing = f"</{wrapper.split()[0]}>"
    extra = "<section id='comments'><article><p>me too</p></article></section><div class='tag-list'>news</div><div class='widget'>buy</div>"
    for body in (f"<article><p>{text}</p></article>{extra}", f"<div class='c'><p>{text}</p></div>" + extra.replace("article", "div")):
        found = style_tree.main_text(style_tree.parsed(f"<body><{wrapper}>{body}{closing}</body>"), set())
        assert found == text.strip()


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_repeated_rows_beside_other_texts_equal_brute_force(spark, group_rows):
    import random

    random.seed(9)
    draw = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    base, own = draw(700), draw(500)
    rows = [(7, base)] * 50 + [(None, own)] * 30 + [(8, base[100:] + draw(60)), (None, draw(300) + own[:200] + "x"), (7, draw(450)), (9, draw(90) + base[300:450])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.deduplicated(df, 120, group_rows=group_rows).collect()
    want = brute_removed([t.encode() for _, t in rows], 120)
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == collections.Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_many_equal_rows_cost_no_more_than_rows_with_ids(spark):
    import time

    text = " ".join(f"word{(i * i) % 991}" for i in range(160))
    took = []
    for own in ("id", "CAST(NULL AS long)"):
        df = spark.range(40_000).selectExpr(f"{own} AS doc_id", f"'{text}' AS text").repartition(8)
        began = time.time()
        found = suffix_dedup.deduplicated(df, 400, with_text=False).groupBy("n_removed", "n_spans").count().collect()
        took.append(time.time() - began)
        assert [tuple(r) for r in found] == [(len(text), 1, 40_000)]
    assert took[1] < 2 * took[0] + 5


def test_the_stage_compares_what_the_trie_gives_and_searches_equal_groups_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = []
    for _ in range(6):
        words = [f"w{v}" for v in rng.integers(0, 10**6, 150)]
        docs.append(" ".join(words))
        for changed in (1, 3, 4):
            other = list(words)
            for i in rng.choice(150, changed, replace=False):
                other[i] = f"x{rng.integers(10**6)}"
            docs.append(" ".join(other))
    compared, searched = [], []
    similar, group_links = simhash_trie.similar, simhash_trie._group_links

    def seen_similar(pairs, *rest):
        compared.extend((r["a"], r["b"]) for r in pairs.collect())
        return similar(pairs, *rest)

    def seen_groups(groups, *rest):
        found = {}
        for r in groups.select("g", "node").collect():
            found.setdefault(r["g"], set()).add(r["node"])
        searched.extend(map(frozenset, found.values()))
        return group_links(groups, *rest)

    monkeypatch.setattr(simhash_trie, "similar", seen_similar)
    monkeypatch.setattr(simhash_trie, "_group_links", seen_groups)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    fps = {r["node"]: r["fp"] % 2**64 for r in simhash_trie.classed(df, 5, "doc_id", "text").select("node", "fp").collect()}
    kept = {r["doc_id"] for r in simhash_trie.without_similar(df).collect()}
    assert kept == set(jaccard_roots(docs))
    assert compared and all((fps[a] ^ fps[b]).bit_count() <= simhash_trie.NARROW for a, b in compared)
    assert searched and len(searched) == len(set(searched))
