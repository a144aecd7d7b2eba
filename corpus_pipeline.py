"""From raw documents to tokens: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns rows that are written and read again before the
next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import bpe, language, mixing, near_copies, pii, queries, simhash
from tallyshelf.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior of a language a text is taken to be in.
SURE = 0.5


def others(docs: DataFrame) -> tuple:
    return tuple(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those in no language for sure, go; a missing ``lang`` is filled in."""
    model = language.train(docs, queries.PIECES, ~queries.held_out())
    found = language.identify(docs, model, keep=others(docs), keep_text=True)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the document with the smallest id stays.

    Sets whose SimHashes are close are compared and linked first; what a SimHash cannot see is completed by bands of least hashes.
    """
    return simhash.first_of_each(docs, near=near_copies.near_copies, words=5, similarity=0.8).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all documents stay."""
    found = pii.find_spans(docs, pii.train(docs), redact=True, keep=others(docs))
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the rate that its domains' target weights give it says."""
    labels = queries.table(spark, sf_dir, "labels")
    mixed = mixing.mix(docs, labels, queries.WEIGHTS, queries.domain_of_labels(), keep=others(docs), keep_text=True)
    mixed = mixed.withColumn("copies", mixing.copies(F.round("rate", 6), F.col("doc_id")))
    once = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return once.select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL cannot express the classifiers, the random field or the merges; tests/llm has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage{k}")
    return docs
