"""Corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``docs``. Any column may hold nulls and an empty table gives an empty
table; rows are told apart without their ids, so repeated rows and ids are kept or dropped one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import line_crf, packing, simhash_trie, suffix_dedup, weak_rules
from riskloom.llm.common import fresh_dir, importable, table

#: Repeated passages of this many bytes or more are removed: about 40 words. All but about 1 % of passages of 51 words hold so many bytes.
PASSAGE_BYTES = 240


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the line model rejects; texts without a word are rejected, and equal texts alike."""
    importable(spark)
    model = line_crf.fitted(docs, table(spark, sf_dir, "labels"))
    return _named(line_crf.scored(docs, model, keep=tuple(docs.columns)).filter("predicted = 1"), docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the weakly supervised rules reject; texts without a word are rejected, and equal texts alike."""
    return weak_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Texts without a word are one group; of rows with the least id, or without any, one stays.
    """
    importable(spark)
    return simhash_trie.without_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur more than once out of every text; null texts become empty, very long ones are gone through in segments."""
    importable(spark)
    columns = docs.columns
    others = [c for c in columns if c not in ("text", "n_chars")]
    cut = suffix_dedup.deduplicated(docs, PASSAGE_BYTES, keep=tuple(others))
    back = {c: F.col(f"kept_{i}") for i, c in enumerate(others)} | {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[back[c].alias(c) for c in columns])


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left: one row per piece; an empty text is its end token alone."""
    importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=400_000, keep_memo=False)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed_sequences", packed_sequences),
]

#: SQL cannot express the learnt stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
