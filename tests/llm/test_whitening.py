"""Whitening against a full decomposition of the covariance, in one piece."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyshelf.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<double>, id string, dim string, x string, n string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in vectors], SCHEMA)


def whole(vectors):
    return np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in vectors], dtype=object)


def check(rows, kept, components=8):
    """``rows`` are those of the vectors ``kept``: (id, vector)."""
    x, n = whole([v for _, v in kept]), len(kept)
    sums = x.sum(axis=0)
    apart = n * x - sums
    centred = apart.astype(float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(rows) == n * k
    want = {}
    for (i, _), dev in zip(kept, (apart**2).sum(axis=1)):
        want.setdefault(i, []).append(dev)
    assert sorted((r.vec_id, r.deviation) for r in rows if r.component == 1) == sorted((i, d) for i, ds in want.items() for d in ds)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9
    for c in range(1, k + 1):
        own = [r for r in rows if r.component == c]
        assert abs(own[0].explained / (values[c - 1] / values.sum()) - 1) < 1e-9
        assert abs(np.mean([r.whitened**2 for r in own]) - 1) < 1e-9
    return centred, values, vectors, k


def test_the_table_by_brute_force(spark):
    rows = queries.op13_whitening(spark, SF).collect()
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    centred, values, vectors, k = check(rows, kept)
    assert k == 8
    got = {(r.vec_id, r.component): r.whitened for r in rows}
    for c in range(k):
        want = centred @ vectors[:, c] / math.sqrt(values[c])
        own = np.array([got[i, c + 1] for i, _ in kept])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-8


def test_settles_before_all_steps_on_a_steep_spectrum(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 60)) * 0.5 ** np.arange(60)).tolist()
    center, table = None, spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id bigint, vector array<double>")
    blocks = table.mapInArrow(whitening.blocks(2.0**30, 5), whitening.BLOCKS)
    center = whitening.center_of(blocks)
    total = float(whitening.summed(blocks, lambda parts: np.array([sum(float((center.rows(x) ** 2).sum()) for x in parts)]))[0])
    found = whitening.bidiagonalise(blocks, center, 4, [], total)
    assert not found.complete and found.vectors.shape[1] < 60
    x = np.floor(np.array(vectors) * 2.0**30)
    want = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(found.values[:4], want[1][:4], rtol=1e-12)
    assert np.allclose(np.abs(found.vectors[:, :4].T @ want[2][:4].T), np.eye(4), atol=1e-10)


def test_equal_eigenvalues(spark):
    vectors = [(2 * i + s, [0.0] * i + [0.5 if s else -0.5] + [0.0] * (11 - i)) for i in range(12) for s in range(2)]
    rows = whitening.whiten(frame(spark, vectors)).collect()
    check(rows, vectors)
    assert all(abs(r.explained - 1 / 12) < 1e-9 for r in rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    kept = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 5)))]
    kept += [(3, kept[3][1])] * 40 + [(7, [9.0] * 5), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    rows = whitening.whiten(frame(spark, kept + odd)).collect()
    named = [(i if i is not None else -1, v) for i, v in kept]
    check([r if r.vec_id is not None else r.__class__(**{**r.asDict(), "vec_id": -1}) for r in rows], named)


def test_dropped_rank_and_nothing(spark):
    line = [(i, [i / 8, -i / 8, 1.0]) for i in range(10)]
    rows = whitening.whiten(frame(spark, line)).collect()
    assert len(rows) == 10 and all(abs(r.explained - 1) < 1e-12 for r in rows)
    for vectors in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(frame(spark, vectors)).count() == 0


def test_deviations_past_64_bits(spark):
    rows = whitening.whiten(frame(spark, [(1, [2.0**45, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.vec_id: r.deviation for r in rows}[1] is None
    assert whitening.whiten(frame(spark, [(i, [2.0**18 * i, 0.5]) for i in range(3)])).where(F.col("deviation").isNull()).count() == 0
