"""Rates against a plain solver, targets met, and the classifier's accuracy on rows it has not seen."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import mixing, queries

from .helpers import clashing, documents

SF = "/root/testdata/sf0.1"
SCORED = "id bigint, n_tokens bigint, posterior array<double>"


def plain_rates(p, n, shares, total, pull):
    """The same problem, solved with many small steps in one place."""
    there, held = n.sum(), n @ p
    base = total / there
    rate = np.full(len(n), base)
    for _ in range(20_000):
        gap = ((rate * n) @ p - shares * total) / np.where(held > 0, held, np.inf)
        rate = np.maximum(0, rate - 0.5 * (p @ gap + pull * (rate - base)))
    return rate


def soft(rng, n, k):
    p = rng.dirichlet(np.full(k, 0.3), size=n)
    return p, rng.integers(1, 900, n)


@pytest.mark.parametrize("weights,total", [([0.9, 0.08, 0.02], None), ([0.2, 0.0, 0.8], 10_000.0)])
def test_rates_solve_the_problem(spark, weights, total):
    rng = np.random.default_rng(1)
    p, n = soft(rng, 300, 3)
    scored = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(300)], SCORED)
    fit = mixing.fit_rates(scored, weights, total, pull=0.2, most=40, tolerance=1e-5)
    got = {r.id: r.rate for r in mixing.rated(scored, fit).collect()}
    shares = np.array(weights) / sum(weights)
    held = n @ p
    total = total or min(h / s for h, s in zip(held, shares) if s)
    want = plain_rates(p, n, shares, total, 0.2)
    assert min(got.values()) >= 0
    assert np.allclose([got[i] for i in range(300)], want, atol=2e-3)


def test_classifier_and_targets_on_the_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = mixing.train(docs, labels.where(~held_out), list(queries.WEIGHTS), queries.domain_of_labels())
    seen = mixing.posteriors(docs.join(labels, "doc_id").where(held_out), model, keep=(queries.domain_of_labels().alias("domain"),))
    names = list(queries.WEIGHTS)
    rows = [(names.index(r.domain), r.posterior) for r in seen.collect()]
    likely = np.mean([np.log(max(p[d], 1e-9)) for d, p in rows])
    prior = np.bincount([d for d, _ in rows], minlength=3) / len(rows)
    assert len(rows) > 500 and likely > (prior * np.log(prior)).sum() + 0.05
    mixed = queries.op2_mixing(spark, SF)
    total = mixed.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in names]).first()
    reached = np.array(total) / sum(total)
    assert np.allclose(reached, list(queries.WEIGHTS.values()), atol=0.01)
    assert mixed.count() == docs.count()
    used, rate = mixed.agg(F.sum("copies"), F.sum("rate")).first()
    assert used == pytest.approx(rate, rel=0.03)


def test_awkward_rows(spark):
    rng = random.Random(2)
    word = {"good": ["apple", "pear"], "low": ["zzz", "qqq"], "toxic": ["vile", "nasty"]}
    kinds = [rng.choice(list(word)) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(word[k]) for _ in range(30))) for i, k in enumerate(kinds)]
    odd = [(500, None), (501, ""), (501, ""), (None, "apple pear"), (502, "apple " * 50_000), (503, "!!")]
    labels = [(i, int(k == "good"), int(k == "toxic")) for i, k in enumerate(kinds)] + [(None, 1, 0), (500, None, None), (3, 1, 0), (9999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("id", F.lit("x")).withColumn("text", F.lit(1))
    table = clashing(documents(spark, docs + odd))
    got = mixing.mix(table, labels, queries.WEIGHTS, queries.domain_of_labels()).collect()
    assert len(got) == 206
    for r in got:
        assert sum(r.posterior) == pytest.approx(1) and r.rate >= 0
        if r.n_tokens == 0:
            assert r.rate == 1
        elif r.doc_id is not None and r.doc_id < 200:
            assert list(word)[int(np.argmax(r.posterior))] == kinds[r.doc_id]
    assert len({(r.rate, tuple(r.posterior)) for r in got if r.doc_id == 501}) == 1


def test_nothing_to_learn_from_or_rate(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = mixing.mix(documents(spark, [(1, "some words"), (2, None)]), labels, queries.WEIGHTS, queries.domain_of_labels()).collect()
    assert all(np.allclose(r.posterior, 1 / 3) for r in got)
    assert mixing.mix(documents(spark, []), labels, queries.WEIGHTS, queries.domain_of_labels()).count() == 0


def test_copies_follow_the_rate(spark):
    table = spark.range(20_000).withColumn("rate", F.lit(1.3))
    used = table.agg(F.avg(mixing.copies(F.col("rate"), F.col("id"))), F.min(mixing.copies(F.col("rate"), F.col("id")))).first()
    assert used[0] == pytest.approx(1.3, abs=0.02) and used[1] == 1


@pytest.mark.parametrize("noise,weights", [(1.0, [0.9, 0.08, 0.02]), (0.5, [0.85, 0.1, 0.05])])
def test_overlapping_posteriors_end_at_the_optimum(spark, noise, weights):
    """No token's rate could be moved to gain more than the tolerance, though posteriors tell domains apart badly."""
    rng = np.random.default_rng(8)
    p = mixing.softmax(np.log([0.6, 0.3, 0.1]) + rng.normal(size=(2000, 3)) * noise)
    n = rng.integers(1, 900, len(p))
    scored = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(len(p))], SCORED)
    fit = mixing.fit_rates(scored, weights)
    got = {r.id: r.rate for r in mixing.rated(scored, fit).collect()}
    rate = np.array([got[i] for i in range(len(p))])
    held = n @ p
    total = min(held / weights)
    reached = (rate * n) @ p
    slope = p @ ((reached - np.array(weights) * total) / held) + 1e-4 * (rate - total / n.sum())
    assert np.abs(slope[rate > 0]).max() < 2e-5 and slope.min() > -2e-5
    assert np.allclose(fit.reached, reached) and np.allclose(fit.shares()[0], weights) and fit.gap <= 1e-5


def test_a_stop_by_the_cap_is_reported(spark):
    rng = np.random.default_rng(9)
    p, n = soft(rng, 200, 3)
    scored = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(200)], SCORED)
    with pytest.warns(UserWarning, match="off their optimum"):
        assert mixing.fit_rates(scored, [0.9, 0.08, 0.02], most=0).gap > 1e-5
