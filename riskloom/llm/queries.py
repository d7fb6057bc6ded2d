"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, line_crf, merkle, packing, periodic_runs, pii_boosting, sharding, simhash_trie, style_tree, suffix_dedup, topk_threshold, warc_zip, weak_rules
from riskloom.llm.common import table


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded bytes of every whole text; null texts are empty."""
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset; null texts have the end id alone."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null pages have the empty text."""
    return style_tree.main_texts(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law ``rows``; null texts have size 1."""
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; empty texts share fingerprint zero."""
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; texts without a word score 0."""
    docs = table(spark, sf_dir, "documents")
    return line_crf.scored(docs, line_crf.fitted(docs, table(spark, sf_dir, "labels")))


def op4_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector; vectors that are null or not finite take no part."""
    vectors = topk_threshold.quantised(table(spark, sf_dir, "embeddings"))
    return topk_threshold.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op5_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, base test and verdict of every document; null texts have no words and fail."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
    return weak_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes that repeated strings of 400 cover, its kept text last; null texts are empty."""
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), least=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives; null pages have the empty payload."""
    read = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans by kind, and all spans with those that the trees add; null texts have none."""
    return pii_boosting.digests(pii_boosting.personal_spans(table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and inclusion proof of every document, folded from a changed row for every seventh; nulls are encoded apart from values."""
    found = merkle.manifest(merkle.document_leaves(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, after a tenth of them got one planted; null texts have no words."""
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_style_tree": op1_style_tree,
    "op2_sharding": op2_sharding,
    "op3_line_crf": op3_line_crf,
    "op4_topk_threshold": op4_topk_threshold,
    "op5_weak_rules": op5_weak_rules,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc_zip": op9_warc_zip,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_pii_boosting": op11_pii_boosting,
    "op12_merkle": op12_merkle,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    # CRC-32 by bytes from its table of 256 remainders
    "op2_sharding": """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS crc),
d AS (SELECT doc_id, source, coalesce(text, '') AS t, coalesce('=' || source, '') AS stratum, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, (CAST(row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS DOUBLE) - 0.5) / count(*) OVER (PARTITION BY stratum) AS fraction FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, md5('8|' || stratum), stratum, h, doc_id) AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(crc[1 + CAST(xor(c, b) % 256 AS INT)], c // 256))) AS BIGINT) AS text_crc32,
  'rows' AS law, CAST((place * 16 - 1) // total AS INTEGER) AS shard, CAST(place - 1 - ((place * 16 - 1) // total) * total // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p, k""",
    "op12_merkle": """
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END)) AS crc),
e AS (SELECT doc_id, lang, n_chars, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(crc[1 + CAST(xor(c, b) % 256 AS INT)], c // 256))) % 7 = 0 AS hit,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM documents, k),
l AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf, CASE WHEN hit THEN sha256(a || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || z) END AS other FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS level, i, n, leaf AS digest FROM d
  UNION ALL SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(digest || coalesce(following, '')) FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY i) AS following FROM t WHERE n > 1) x WHERE i % 2 = 0),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, n, subroot AS digest FROM s
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(digest || coalesce(following, '')) FROM (SELECT *, lead(digest) OVER (ORDER BY i) AS following FROM u WHERE n > 1) x WHERE i % 2 = 0),
w AS (SELECT DISTINCT level, n FROM u WHERE n > 1), v AS (SELECT DISTINCT lang, level, n FROM t WHERE n > 1),
q AS (SELECT s.lang, list(CASE WHEN u.digest IS NULL THEN 'N' WHEN (s.i >> w.level) % 2 = 0 THEN 'R' || u.digest ELSE 'L' || u.digest END ORDER BY w.level) AS steps FROM s CROSS JOIN w LEFT JOIN u ON u.level = w.level AND u.i = xor(s.i >> w.level, 1) GROUP BY s.lang),
p AS (SELECT d.lang, d.i, list(CASE WHEN t.digest IS NULL THEN 'N' WHEN (d.i >> v.level) % 2 = 0 THEN 'R' || t.digest ELSE 'L' || t.digest END ORDER BY v.level) AS steps FROM d JOIN v ON v.lang IS NOT DISTINCT FROM d.lang LEFT JOIN t ON t.lang IS NOT DISTINCT FROM d.lang AND t.level = v.level AND t.i = xor(d.i >> v.level, 1) GROUP BY d.lang, d.i),
m AS (SELECT d.*, s.subroot, list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) AS steps, (SELECT digest FROM u WHERE n = 1) AS root FROM d LEFT JOIN p ON p.lang IS NOT DISTINCT FROM d.lang AND p.i = d.i LEFT JOIN q ON q.lang IS NOT DISTINCT FROM d.lang JOIN s ON s.lang IS NOT DISTINCT FROM d.lang),
f AS (SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(steps, lambda x: substr(x, 2))), 'string_agg', '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(other, leaf), steps), lambda a, x: CASE x[1] WHEN 'N' THEN sha256(a) WHEN 'R' THEN sha256(a || substr(x, 2)) ELSE sha256(substr(x, 2) || a) END) AS folded_root FROM m)
SELECT *, folded_root = root AS verified FROM f""",
    "op4_topk_threshold": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS response_id FROM p GROUP BY h),
d AS (SELECT page_id, strlen(p.h) AS payload_bytes, CAST(unhex(sha1(p.h)) AS BIT)::VARCHAR AS b, response_id FROM p JOIN g ON p.h = g.h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(b, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
    + 4 * CAST(substr(b, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(b, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(b, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to FROM d""",
}
