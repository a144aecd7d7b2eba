"""The pipeline's stages: what goes, what stays, and what becomes of it."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyshelf.llm import pii, queries

from .helpers import documents
from .test_near_copies import pairs_and_firsts

SF = "/root/testdata/sf0.01"


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]


def encoding():
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_each_stage_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}

    kept = corpus_pipeline.language_id(spark, docs, SF)
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == docs.columns
    gone = [d for d in given if d not in rows]
    assert len(gone) <= 2 and all(rows[d] == given[d] for d in rows)

    one = corpus_pipeline.near_dedup(spark, docs, SF)
    ids = sorted(given)
    _, firsts = pairs_and_firsts([(d, given[d].text) for d in ids])
    want = {ids[k] for k in firsts}
    assert sorted(r.doc_id for r in one.collect()) == sorted(want)
    assert {r.doc_id: r for r in one.collect()} == {d: given[d] for d in want}

    clean = corpus_pipeline.personal_data(spark, docs, SF)
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and after.keys() == given.keys()
    changed = 0
    for d, r in after.items():
        assert r.n_chars == len(r.text) and not [s for s in pii.base_spans(r.text) if s[0] != 2]
        if not any(c.isdigit() or c == "@" for c in given[d].text):
            assert r.text == given[d].text
        changed += r.text != given[d].text
    assert changed >= sum(bool(pii.base_spans(r.text)) for r in given.values()) > 20

    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and all(r == given[r.doc_id] for r in mixed.collect())
    good = {r.doc_id for r in queries.op2_mixing(spark, SF).where("p_good >= 0.95").collect()}
    assert len(good) > 0.4 * len(given) and good <= {r.doc_id for r in mixed.collect()}


def test_whole_pipeline(spark):
    result = corpus_pipeline.run(spark, SF)
    rows = result.collect()
    given = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) > 0.5 * len(given) and {r.doc_id for r in rows} <= given
    known = encoding()
    for r in rows[:200]:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        text = known.decode_bytes(ids)
        assert len(ids) == r.n_tokens and known.encode_ordinary(text.decode()) == ids
        assert hashlib.sha256(text).hexdigest() == r.decoded_sha256


def test_awkward_rows(spark):
    taught = [(i, f"the cat number {chr(97 + i % 26)} and the dog {'x' * (i % 7)} " * 3) for i in range(40)]
    odd = [(100, None), (101, ""), (102, "123"), (None, "the dog and the cat"), (103, "the cat"), (103, "the cat"), (104, "a@b.cd the dog")]
    docs = documents(spark, taught + odd).withColumn("lang", F.when(F.col("doc_id").isNotNull() & (F.col("doc_id") != 104), F.lit("en")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        found = [r.doc_id for r in docs.collect()]
        assert not {100, 101, 102} & set(found), name
        if name == "SimHash near-dedup":
            assert found.count(103) == 1
        if name == "PII":
            assert "[EMAIL] the dog" in {r.text for r in docs.collect()}
    assert docs.where("lang is null").isEmpty()
    coded = corpus_pipeline.tokens(spark, docs, SF)
    assert coded.count() == docs.count()


def test_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0
