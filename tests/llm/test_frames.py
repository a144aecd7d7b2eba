"""Memory of tasks."""

import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest

from tallyshelf.llm import _frames, mixing, pii

from .helpers import documents


def test_memory_is_given_back_when_nothing_is_held(monkeypatch):
    held, alive = [], []
    monkeypatch.setattr(_frames, "give_back", lambda: alive.extend(ref() is not None for ref in held))

    def run(batches):
        for _ in batches:
            big = np.zeros(1000)
            held.append(weakref.ref(big))
            yield len(big)

    assert list(_frames.trimmed(run)(iter([1, 2]))) == [1000, 1000]
    assert alive == [False, False]


@pytest.mark.parametrize("stage", ["mixing", "personal data"])
def test_stages_work_on_little_text_at_a_time(spark, monkeypatch, stage):
    held, docs = [], documents(spark, [(1, "a b")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kinds: held.append(run) or self)
    if stage == "mixing":
        mixing.posteriors(docs, mixing.Classifier(np.zeros((mixing.FEATURES, 6)), np.zeros((6, 3)), np.zeros(3)))
    else:
        pii.find_spans(docs, pii.Field(np.zeros((pii.shape_features().shape[1], pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 0.0))
    text = pa.array(["one more word and 12 others, " * 70] * 1000)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(1000)), text], ["id", "text"])] * 5
    tracemalloc.start()
    try:
        n = sum(batch.num_rows for batch in held[0](iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 5000 and peak < 64 << 20
