"""Patterns against plain regular expressions, the field against enumeration, and what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from tallyshelf.llm import pii, queries

from .helpers import clashing, documents, rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def expected(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def found(text):
    return [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)]


def test_patterns_equal_plain_ones():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "456", "0000", "4111111111111111", "(", ")", "255", "256", "é", "\n", "%", "@x.y", "1.2.3.4"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))
        assert found(text) == expected(text), text


def test_long_texts_stay_linear():
    assert found("1" * 300_000) == [] and found("a" * 300_000 + "@") == []
    assert found("a" * 100_000 + "@b.c") == [("email", 0, 100_004)]


def test_messages_are_exact_without_loops():
    rng = np.random.default_rng(2)
    n = 5
    field = pii.Field(rng.normal(size=(19, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), 1.3)
    shapes = rng.integers(0, pii.SHAPES, n)
    held = np.array([pii.ABSENT, 3, pii.ABSENT, pii.ABSENT, pii.ABSENT])
    chain, skip = np.array([[0, 1], [1, 2], [2, 3]]), np.array([[2, 4]])
    graph = pii.Graph(shapes, np.zeros(n, int), np.arange(n), np.arange(n) + 1, held, chain, skip)
    own = (pii.shape_features() @ field.token)[shapes]
    total = np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n):
        if y[1] != 3:
            continue
        score = sum(own[k, y[k]] for k in range(n) if k != 1) + sum(field.chain[y[a], y[b]] for a, b in chain)
        score += sum(field.skip * (y[a] == y[b]) for a, b in skip)
        for k in range(n):
            total[k, y[k]] += np.exp(score)
    got = pii.marginals(graph, field, rounds=60)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def texts():
    rng = random.Random(3)
    number = lambda: f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    docs = []
    for i in range(300):
        words = [f"w{chr(97 + rng.randrange(26))}x" for _ in range(rng.randrange(5, 60))]
        extra = rng.choice([f"+1 {number()}", f"mail{i}@host{i % 9}.example.com", "10.0.{}.7".format(i % 256), str(rng.randrange(1900, 2100)), "x"])
        words.insert(rng.randrange(len(words)), extra)
        docs.append((i, " ".join(words)))
    return docs


def test_repeated_mentions_take_the_label(spark):
    docs = texts()
    repeated = (1000, "Call +1 (546) 555-9275 today. If busy, try 555-9275 again or 555-9275, and not 12 apples in 1999.")
    clean = (1001, "In 1999 there were 12 apples and 555 pears; see chapter 7.")
    table = documents(spark, docs + [repeated, clean])
    field = pii.train(table)
    assert field.skip > 0
    spans = {r.doc_id: r.spans for r in pii.find_spans(table, field).collect()}
    text = repeated[1]
    assert {text[s.start : s.end] for s in spans[1000] if not s.base and s.kind == "phone"} == {"555-9275"}
    assert sum(not s.base for s in spans[1000]) == 2
    assert spans[1001] == []
    for doc, text in docs:
        assert [(s.kind, s.start, s.end) for s in spans[doc] if s.base] == expected(text)


def test_awkward_rows(spark):
    odd = [(1, None), (2, ""), (3, "é ü a@b.cd 中 1.2.3.4"), (3, "é ü a@b.cd 中 1.2.3.4"), (None, "x@y.z"), (4, "1 " * 20_000), (5, "9" * 50_000)]
    table = clashing(documents(spark, odd))
    got = pii.find_spans(table, pii.train(table), redact=True)
    want = [(i, [p for p in expected(t)], None if t is None else pii.redacted(t, pii.base_spans(t))) for i, t in odd]
    seen = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base], r.redacted) for r in got.collect()]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert "é ü [EMAIL] 中 [IP]" in {r[2] for r in seen}


def test_empty_table(spark):
    empty = documents(spark, [])
    assert pii.find_spans(empty, pii.train(empty)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        spans = expected(r.text)
        counts = [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((r.doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest()))
    got = queries.op3_pii(spark, sf)
    assert rows(got.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256")) == sorted(want, key=repr)


def test_redacted_overlaps():
    assert pii.redacted("abcdef", [(3, 0, 4), (2, 2, 6)]) == "[PHONE]"
    assert pii.redacted("ab cd", [(0, 0, 2), (1, 3, 5)]) == "[EMAIL] [IP]"
    assert pa.array([[]], pii.SPANS).to_pylist() == [[]]


def mentions_in_a_row(n, skip):
    edges = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    held = np.full(n, pii.ABSENT)
    held[0] = 3
    field = pii.Field(np.zeros((19, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), skip)
    return pii.Graph(np.zeros(n, int), np.zeros(n, int), np.arange(n), np.arange(n) + 1, held, np.zeros((0, 2), int), edges), field


def test_messages_reach_every_mention():
    n, skip = 60, 10.0
    got = pii.marginals(*mentions_in_a_row(n, skip))[:, 3]
    turn = np.exp(-skip) / (np.exp(-skip) * 4 + 1)  # to one other label over an edge
    want = 0.2 + 0.8 * (1 - 5 * turn) ** np.arange(n)
    assert np.allclose(got, want, atol=1e-5) and got[-1] > 0.95


def test_a_text_does_not_depend_on_others():
    column = ["Call +1 (546) 555-9275, 555-9275 or 12 12 1999", " ".join(f"555-{k % 7}275 {k}" for k in range(200))]
    field = pii.Field(np.random.default_rng(4).normal(size=(19, pii.LABELS)), np.random.default_rng(5).normal(size=(pii.LABELS, pii.LABELS)), 2.0)
    one, both = (pii.graph_of(pa.chunked_array([pa.array(c)]))[0] for c in (column[:1], column))
    assert np.array_equal(pii.marginals(one, field), pii.marginals(both, field)[: len(one.text)])


def test_dozens_of_repeats_take_the_label(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice("abcdefg") * 4 for _ in range(20))
    text = "Call +1 (546) 555-9275 today. " + " ".join(f"{filler()} call 555-9275 again" for _ in range(60))
    table = documents(spark, texts() + [(1000, text), (1001, text[30:] + " Or +1 (546) 555-9275")])
    spans = {r.doc_id: (r.spans, r.redacted) for r in pii.find_spans(table, pii.train(table), redact=True).collect()}
    for doc in (1000, 1001):
        found, clean = spans[doc]
        assert sum(not s.base and s.kind == "phone" for s in found) == 60 and "555-9275" not in clean
