"""Exact search against brute force in whole numbers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyshelf.llm import topk

from .helpers import rows

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vector string, rank int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in vectors], SCHEMA)


def expected(vectors, k):
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in kept]
    out, seen = [], set()
    for i, q in whole:
        if i is None or i % 100 or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        found = [(-cut(sum(a * b for a, b in zip(q, v))), j is None, j or 0, j) for j, v in whole if j != i and len(v) == len(q)]
        for r, (s, _, _, j) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1):
            out.append((i, r, j, -s))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    make = lambda d: [rng.uniform(-1, 1) for _ in range(d)]
    vectors = [(i, make(8)) for i in range(700)]
    hot = make(8)
    vectors += [(1000 + i, hot) for i in range(400)] + [(100, vectors[100][1])]
    vectors += [(None, make(8)), (None, hot), (5000, None), (5001, [None, 1.0]), (5100, [float("nan")] * 8), (5200, [math.inf] * 8)]
    vectors += [(6000, [0.5, 0.5]), (6001, [0.25, -0.5]), (6100, []), (6101, []), (6200, [0.0] * 8)]
    got = topk.top_k(frame(spark, vectors), F.col("vec_id") % 100 == 0)
    assert rows(got) == expected(vectors, 10)


def test_products_too_large_for_doubles(spark):
    vectors = [(0, [3e9, 1.0]), (1, [2e9, -1.0]), (2, [1e30, 1e30]), (3, [-1e30, 0.0]), (4, [1e9, 3.0])]
    got = topk.top_k(frame(spark, vectors), F.col("vec_id") % 100 == 0)
    assert rows(got) == expected(vectors, 10)


def test_fewer_candidates_and_empty(spark):
    assert rows(topk.top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0)) == []
    assert topk.top_k(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_copies_of_queries_are_not_broadcast(spark):
    """There are as many as there are groups of shards, which Spark's estimate does not know."""
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(500)]
    got = topk.top_k(frame(spark, vectors), F.col("vec_id") % 100 == 0)
    assert rows(got) == expected(vectors, 10)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
