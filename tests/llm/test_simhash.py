"""SimHash groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from tallyshelf.llm import components, simhash
from tallyshelf.llm._text import SPACED, find_words
from tallyshelf.llm.xxh64 import xxh64

from .helpers import clashing, documents, rows


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    to = {n: n for n in nodes}

    def top(n):
        while to[n] != n:
            n = to[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        to[b] = a
    return {n: top(n) for n in nodes}


def expected(docs):
    codes = [fingerprint(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 4]
    of = groups(range(len(docs)), near)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[of[i]] = min(doc, least.get(of[i], doc))
    return sorted(((d, f"{codes[i]:016x}", least.get(of[i])) for i, (d, _) in enumerate(docs)), key=repr)


def words(rng, n):
    return " ".join(f"w{rng.randrange(40)}" for _ in range(n))


def test_hashes_equal_the_library():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(4000))
    starts = np.array([rng.randrange(3500) for _ in range(300)])
    ends = starts + np.array([rng.randrange(200) for _ in range(300)])
    got = xxh64(np.frombuffer(data, np.uint8), starts, ends, 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \n", "A", "a b", "a b c", "a\tb\nc  D", "x" * 99, "é ü 中 文 " * 9] + [words(rng, n) for n in range(1, 60)]
    got = simhash.fingerprints(find_words(pa.array(texts), SPACED, lower=True), 4)
    assert got.view(np.uint64).tolist() == [fingerprint(t) for t in texts]


def test_links_in_groups_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(25):
        base = rng.integers(0, 2**64, size=rng.integers(1, 6), dtype=np.uint64)
        codes = base[rng.integers(0, len(base), rng.integers(1, 300))]
        for _ in range(rng.integers(0, 6)):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, len(codes)).astype(np.uint64)) * (rng.random(len(codes)) < 0.7)
        codes = np.unique(codes)
        group = np.sort(rng.integers(0, 2, len(codes)))
        nodes = list(zip(group.tolist(), codes.tolist()))
        near = [(x, y) for i, x in enumerate(nodes) for y in nodes[:i] if x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= 4]
        of = dict(zip(codes.tolist(), group.tolist()))
        a, b = simhash.link_groups(group, codes, 4)
        found = [((of[x], x), (of[y], y)) for x, y in zip(a.tolist(), b.tolist())]
        assert groups(nodes, near) == groups(nodes, found)


def test_every_near_pair_shares_a_top_node():
    rng = random.Random(4)
    top = simhash.masks(6, 4)
    assert len(top) == 15
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not apart & m for m in top)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(60)] + [(7, 7), (3, None)]
    table = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(table).collect()}
    assert found == {n: 0 for n in range(1, 61)} | {n: 100 for n in [*range(101, 160), 200]}
    assert components.components(table.limit(0)).count() == 0


def test_components_make_no_round_over_stars(spark, monkeypatch):
    written = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda df, label: written.append(label) or settle(df, label))
    stars = [(i, i % 7) for i in range(7, 400)] + [(3, 3), (9, 2)]  # about 0 to 6, a link either way round, one repeated
    table = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in stars], "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(table.limit(0)).collect()}
    assert found == {} and len(written) == 1
    found = {r.node: r.root for r in components.components(table).collect()}
    assert found == {n: n % 7 for n in range(7, 400)}
    assert len(written) == 2


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randrange(1, 300))) for i in range(60)]
    for i in range(60, 160):  # near copies: a word of a longer text changed
        parts = docs[rng.randrange(60)][1].split()
        parts[rng.randrange(len(parts))] = "other"
        docs.append((i, " ".join(parts)))
    docs += [(7, docs[7][1])] * 2 + [(None, docs[3][1]), (None, "alone and unnamed"), (900, None), (901, ""), (902, " \n")]
    docs += [(1000 + i, docs[5][1]) for i in range(50)] + [(2000, words(rng, 30_000))]
    found = simhash.near_duplicates(clashing(documents(spark, docs)))
    found = found.select("doc_id", simhash.hex_digits("fp"), "component_id")
    assert rows(found) == expected(docs)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
