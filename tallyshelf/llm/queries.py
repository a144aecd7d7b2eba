"""One query for each operator, over whole tables, and SQL for the same rows where there is any."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, language, language_model, licenses, mixing, pii, simhash, substring_dedup, topk, urls, whitening

Query = Callable[[SparkSession, str], DataFrame]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_PAIRS = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Domains of documents by their labels, and the share of tokens each is to have.
WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}


def domain_of_labels() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), table(spark, sf, "labels"), WEIGHTS, domain_of_labels())
    shares = [F.round(F.element_at("posterior", k), 6).alias(f"p_{d}") for k, d in enumerate(WEIGHTS, 1)]
    rate = F.round("rate", 6)
    return mixed.select("doc_id", "n_tokens", *shares, rate.alias("rate"), mixing.copies(rate, F.col("doc_id")).alias("copies"))


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = pii.find_spans(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.places(base).cast("binary"), 256).alias("base_sha256"),
        pii.places(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"),
    )


def op4_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents")).drop("blocks")


#: Rules on hosts and beginnings of paths.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages"), listed)


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def held_out() -> Column:
    """Documents no classifier learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs, PIECES, ~held_out())
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf, "documents"))
    return linked.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return language_model.score(table(spark, sf, "documents"), held)


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), BYTE_PAIRS, public_tokenizers.PATTERN, PIECES)


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def queries() -> dict[str, Query]:
    named = (op1_substring_dedup, op2_mixing, op3_pii, op4_licenses, op5_url_filter, op6_language, op7_topk, op8_simhash, op9_ann, op10_bpe)
    named += (op11_lm_scoring, op12_alignment, op13_whitening,)
    return {query.__name__: query for query in named}


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _by_rule(value: Callable[[tuple], str]) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(r[0], r[1])} THEN '{value(r)}'" for r in ordered)


URLS = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, {_by_rule(lambda r: r[0] + r[1])} END AS rule,
  {_by_rule(lambda r: r[2])} ELSE 'allow' END AS verdict
FROM parts
"""

TOP_K = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": URLS, "op7_topk": TOP_K}
