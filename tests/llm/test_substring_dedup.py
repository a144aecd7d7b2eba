"""Removed windows against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyshelf.llm import queries, substring_dedup

from .helpers import clashing, documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(docs, window):
    texts = [(d, WORD.findall(t or "")) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def test_levels():
    assert substring_dedup.level_lengths(35, 9) == [9, 18, 35]
    assert substring_dedup.level_lengths(8, 2) == [2, 4, 8]
    assert substring_dedup.level_lengths(3, 9) == [3]


def test_anchors_are_the_first_least():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 300, dtype=np.uint64) << np.uint64(40)
    for span in (1, 2, 3, 7, 27):
        got = substring_dedup.anchors(hashes, span)
        assert got.tolist() == [i + int(hashes[i : i + span].argmin()) for i in range(300 - span + 1)]


@pytest.mark.parametrize("window,letters", [(35, 3000), (4, 12), (8, 3), (1, 30)])
def test_equals_brute_force(spark, window, letters):
    rng = random.Random(window)
    make = lambda n: " ".join(f"w{rng.randrange(letters)}" for _ in range(n))
    passages = [make(window + k) for k in range(6)]
    docs = []
    for i in range(120):
        parts = [make(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), make(rng.randrange(0, 40))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[8][1]), (None, make(50))]
    docs += [(2000, None), (2001, ""), (2002, " \n "), (2003, "é " * 300), (2004, make(20_000)), (2005, "x" * 5000)]
    got = substring_dedup.remove_repeats(clashing(documents(spark, docs)), window)
    assert rows(got) == expected(docs, window)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, gone) for d, _, n, gone in expected([(r.doc_id, r.text) for r in table], 35)}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in queries.op1_substring_dedup(spark, sf).collect()}
    assert got == want and sum(gone for _, gone in want.values()) > 0


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0
