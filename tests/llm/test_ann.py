"""Recall of the tree search against brute force, and exact scores."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import ann, queries

from .test_topk import frame


def brute(vectors, k, every):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out, seen = {}, set()
    for i, q in kept:
        if i is None or i % every or (i, q.tobytes()) in seen:
            continue
        seen.add((i, q.tobytes()))
        near = [(-float(ann.cosine(q[None], v[None])[0]), j is None, j or 0, j) for j, v in kept if j != i and len(v) == len(q)]
        out[i] = [(r, j, -s) for r, (s, _, _, j) in enumerate(sorted(near, key=lambda x: x[:3])[:k], 1)]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({j for _, j, _ in got.get(q, [])} & {j for _, j, _ in best}) for q, best in want.items())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([(r.vec_id, r.embedding) for r in table], 5, 50)
    got = by_query(queries.op9_ann(spark, sf))
    assert got.keys() == want.keys() and all([r for r, _, _ in v] == [1, 2, 3, 4, 5] for v in got.values())
    assert recall(got, want) >= 0.9
    exact = {(q, j): s for q, best in want.items() for _, j, s in best}
    for q, best in got.items():
        assert [s for _, _, s in best] == sorted((s for _, _, s in best), reverse=True)
        assert all(s == pytest.approx(exact[q, j], abs=1e-15) for _, j, s in best if (q, j) in exact)


def test_many_leaves_keep_the_recall(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=12).tolist()) for i in range(3000)]
    table = frame(spark, vectors)
    index = ann.build(table, sample_rows=1000, leaf_rows=40)
    assert 20 < len(index.trees[12].leaf) and index.visits[12] < len(index.trees[12].leaf)
    assert index.blocks.agg(F.sum(F.length("ids"))).first()[0] == 8 * 3000
    got = by_query(ann.nearest(table, F.col("vec_id") % 50 == 0, index=index))
    assert recall(got, brute(vectors, 5, 50)) >= 0.9


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    make = lambda d=6: rng.normal(size=d).tolist()
    hot = make()
    vectors = [(i, make()) for i in range(200)] + [(1000 + i, hot) for i in range(500)] + [(50, None), (2000, [0.0] * 6), (2050, [])]
    vectors += [(None, make()), (None, hot), (2100, [float("nan")] * 6), (2150, [None] * 6), (3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    vectors += [(100, vectors[100][1])]
    got = by_query(ann.nearest(frame(spark, vectors), F.col("vec_id") % 50 == 0, recall=1.0, calibration_queries=10_000))
    want = brute(vectors, 5, 50)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [(r, j) for r, j, _ in got[q]] == [(r, j) for r, j, _ in best]


def test_empty_table(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_queries_travel_once_to_a_group(spark):
    """Not once to each leaf they visit, and never by broadcast."""
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=12).tolist()) for i in range(3000)]
    table = frame(spark, vectors)
    index = ann.build(table, sample_rows=1000, leaf_rows=40)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0, index=index, k=5)
    assert recall(by_query(got), brute(vectors, 5, 50)) >= 0.9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "q_vectors" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_few_rows_of_a_leaf_are_held(spark, monkeypatch):
    """Blocks go on once some bytes are held, however many leaves there are."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(4000, 8))
    tree = ann.Tree(ann.unit(rows), 8, 2)
    monkeypatch.setattr(ann, "HELD", 20_000)
    taken = []

    def batches():
        for at in range(0, len(rows), 100):
            taken.append(at)
            yield pa.RecordBatch.from_pydict({"id": np.arange(at, at + 100), "vector": pa.array(rows[at : at + 100].tolist(), pa.list_(pa.float64()))})

    found = {}
    for batch in ann._pack({8: tree})(batches()):
        for row in batch.to_pylist():
            block = ann.Block.unpack(row["dim"], row["ids"], row["vectors"])
            assert (tree.descend(ann.unit(block.vectors)) == row["leaf"]).all() and (np.diff(block.ids) > 0).all()
            found |= dict(zip(block.ids.tolist(), block.vectors.tolist()))
            assert len(found) > 100 * (len(taken) - 5)
    assert found == dict(enumerate(rows.tolist()))


def test_search_is_exact_over_all_visited_rows(monkeypatch):
    """Also once lists have been cut and further rows have to beat them."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(ann, "QUERIES", 64)
    rows, asked = rng.normal(size=(2000, 6)), rng.normal(size=(4500, 6))
    leaf, ids = rng.integers(0, 20, 2000), np.arange(2000)
    blocks = pa.table({"dim": [6] * 20, "leaf": list(range(20)), "ids": [ids[leaf == x].astype("<i8").tobytes() for x in range(20)], "vectors": [rows[leaf == x].tobytes() for x in range(20)]})
    seen = rng.random((4500, 20)) < 0.7
    queries = pa.table({"dim": [6], "ids": [np.arange(10_000, 14_500).astype("<i8").tobytes()], "vectors": [asked.tobytes()], "seen": [np.packbits(seen, axis=1).tobytes()]})
    (got,) = ann.search(queries, blocks, 5)
    have = {}
    for r in got.to_pylist():
        have.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    scores = ann.unit(asked) @ ann.unit(rows).T
    for q in range(4500):
        best = sorted((-s, i) for i, s in enumerate(scores[q]) if seen[q, leaf[i]])[:5]
        assert [i for i, _ in have[10_000 + q]] == [i for _, i in best]
