"""Merkle manifest: against a plain tree, on hot and messy tables, with other fan-outs and small parts."""

import hashlib
import zlib

from riskloom.llm import merkle as M
from riskloom.llm import queries
from tests.compare import assert_same


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes, base):
    """The root of a list of digests and the siblings of each on the way to it."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + base] for k in range(0, len(nodes), base)]
        for i, k in enumerate(at):
            ways[i].append((k % base, [x for j, x in enumerate(runs[k // base]) if j != k % base]))
        at, nodes = [k // base for k in at], [sha("".join(r)) for r in runs]
    return nodes[0], ways


def plain_manifest(rows, base=2):
    """All columns by lists in memory; rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        of = lambda n, r=r: sha("".join(map(field, (r[0], r[1], r[2], n, r[4]))))
        hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, of(r[3]), of(r[3] + 1) if hit else None, r[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: plain_tree([leaf[2] for leaf in sorted(trees[x], key=lambda t: t[:3])], base) for x in langs}
    root, above = plain_tree([made[x][0] for x in langs], base) if langs else ("", [])
    out = []
    for x, over in zip(langs, above, strict=True):
        subroot, ways = made[x]
        for (_, _, leaf, other, doc_id), way in zip(sorted(trees[x], key=lambda t: t[:3]), ways, strict=True):
            steps, node = way + over, other or leaf
            for k, others in steps:
                node = sha("".join([*others[:k], node, *others[k:]]))
            out.append((doc_id, leaf, subroot, root, sha("".join(s for _, others in steps for s in others)), node, node == root))
    return sorted(out, key=str)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query_equals_sql_and_plain_tree(spark, small, oracle):
    found = queries.op12_merkle(spark, small)
    assert_same(found, oracle, queries.ORACLES["op12_merkle"])
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows_of(spark.read.parquet(f"{small}/documents.parquet")))


def test_other_fan_outs_and_small_parts(spark):
    for n, base, merged, parts in ((1, 2, 2, 3), (2, 3, 2, 5), (97, 2, 2, 24), (250, 3, 3, 12)):
        rows = [(k * 3, "s", None if k % 7 == 0 else "én"[k % 2 :] if k % 5 else "zz", k, f"text {k}") for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = M.manifest(M.document_leaves(df), base, merged).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sorted(map(tuple, found), key=str) == plain_manifest(rows, base), (n, base, merged)


def test_messy_repeated_and_empty_tables(spark, messy, nothing):
    more = messy.union(messy)
    got = sorted(map(tuple, M.manifest(M.document_leaves(more)).collect()), key=str)
    assert got == plain_manifest(rows_of(more))
    assert M.manifest(M.document_leaves(nothing)).count() == 0


def test_equal_rows_do_not_meet_in_one_part(spark):
    df = spark.range(6000).selectExpr("CAST(NULL AS long) AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "'same' AS text").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = M.indexed(M._leaves(M.document_leaves(df)), ["order", "digest"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2500
    assert sorted(r["idx"] for r in placed.collect()) == list(range(6000))


def test_a_changed_row_does_not_verify_and_all_nodes_are_recorded(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = M.manifest(M.document_leaves(docs))
    for r in found.collect():
        assert r["verified"] == (zlib.crc32(str(r["id"]).encode()) % 7 != 0)
    nodes = M.manifest_nodes(M.document_leaves(docs)).collect()
    for lang, n in docs.groupBy("lang").count().collect():
        want = 0
        while n > 1:
            n = -(-n // 2)
            want += n
        assert sum(x["tree"] == lang for x in nodes) == want
    assert len({(x["tree"], x["level"], x["idx"]) for x in nodes}) == len(nodes)
