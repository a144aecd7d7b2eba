"""The pipeline's near copies against brute force over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyshelf.llm import near_copies
from tallyshelf.llm._frames import row_keys

from .helpers import documents


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def pairs_and_firsts(docs, limit=0.8):
    """Pairs of at least that similarity (i < j), and the least id of each component."""
    sets = [shingles(t) for _, t in docs]
    pairs = []
    root = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / len(sets[i] | sets[j]) >= limit:
                pairs.append((i, j))
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return pairs, root


def near_docs():
    """Texts with copies in which some words differ: similarities from 0.6 to 1."""
    rng = random.Random(7)
    docs = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        docs.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            words = list(base)
            for k in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.005, 0.05)))):
                words[k] = f"x{rng.randrange(5000)}"
            docs.append(" ".join(words))
    template = [f"t{k}" for k in range(200)]
    docs += [" ".join(template[:k] + [f"own{k}"] + template[k + 1 :]) for k in range(0, 200, 2)]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_stage_finds_all_near_copies(spark):
    docs = near_docs()
    pairs, root = pairs_and_firsts(docs)
    assert len({i for p in pairs for i in p}) > 150
    got = {r.doc_id: r.root for r in near_copies.near_copies(documents(spark, docs)).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) == len(pairs)
    assert len(set(got.values())) == len(set(root))
    kept = corpus_pipeline.near_dedup(spark, documents(spark, docs), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_limit_is_exact(spark):
    words = [f"w{k}" for k in range(49)]  # 45 shingles; 40 of 50 are shared
    docs = [(1, " ".join(words)), (2, " ".join([*words[:44], *(f"y{k}" for k in range(5))])), (3, " ".join([*words[:43], *(f"z{k}" for k in range(6))]))]
    pairs, _ = pairs_and_firsts(docs)
    assert (0, 1) in pairs and (0, 2) not in pairs
    got = {r.doc_id: r.root for r in near_copies.near_copies(documents(spark, docs)).collect()}
    assert got[1] == got[2]


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "!"), (4, "the cat"), (4, "the cat"), (None, "The  Cat"), (5, "a b c d e f"), (6, "b c d e f")]
    got = [(r.doc_id, r.root) for r in near_copies.near_copies(documents(spark, docs)).collect()]
    assert len(got) == len(docs)
    roots = {}
    for d, r in got:
        roots.setdefault(d, set()).add(bytes(r))
    assert roots[1] == roots[2] != roots[3] and roots[4] == roots[None] and len(roots[4]) == 1 and roots[5] != roots[6]
    assert near_copies.near_copies(documents(spark, [])).count() == 0


def test_bytes_of_least_values():
    assert near_copies.least_equal(1.0) == 80 and 44 <= near_copies.least_equal(0.8) <= 52


def test_equal_bytes(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(50):
        a = [rng.randrange(256) for _ in range(80)]
        b = [x if rng.random() < 0.6 else rng.randrange(256) for x in a]
        packed = [[int.from_bytes(bytes(v[k : k + 8]), "little", signed=True) for k in range(0, 80, 8)] for v in (a, b)]
        rows.append((*packed, sum(x == y for x, y in zip(a, b))))
    found = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, n int").select(near_copies.equal_bytes("a", "b").alias("got"), "n")
    assert all(r.got == r.n for r in found.collect())
    shared = [[k for k in range(20) if a[k // 2] >> 32 * (k % 2) & 0xFFFFFFFF == b[k // 2] >> 32 * (k % 2) & 0xFFFFFFFF] for a, b, _ in rows]
    assert sum(map(len, shared)) > 60
    for place in (0, 3, 19):
        frame = spark.createDataFrame([(i, a, b, place) for i, (a, b, _) in enumerate(rows)], "i int, a array<bigint>, b array<bigint>, place int")
        got = {r.i for r in frame.where(near_copies.first_shared("a", "b", "place")).collect()}
        assert got == {i for i, own in enumerate(shared) if not own or own[0] >= place}


def test_last_pairs_may_be_similar(spark):
    """No pair of the limit is seen off, whatever the sizes; of small sets nearly none at 0.75 is left."""
    rng = random.Random(4)
    sets, pairs = [], []
    for n in (5, 40, 120, 400, 890, 960, 1005, 1300):
        for share in (0.8, 0.75):
            for grows in (1.0, 1.12):
                for _ in range(10):
                    m = round(n * grows)
                    both = min(n, int(np.ceil(share * (n + m) / (1 + share))) if share == 0.8 else int(share * (n + m) / (1 + share)))
                    one = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n + m - both)]
                    pairs.append((len(sets), n, m, both / (n + m - both)))
                    sets += [sorted(one[:n]), sorted(one[n - both :])]
    table = spark.createDataFrame([(k.to_bytes(8, "big"), s) for k, s in enumerate(sets)], "s binary, shingles array<bigint>")
    made = {int.from_bytes(r.s, "big"): r for r in near_copies.wide_sketches(table, 0.8).collect()}
    assert all(bool(r.bins) == (len(sets[k]) < 1000) and bool(r.wide) == (len(sets[k]) >= 799) for k, r in made.items())
    rows = [(k, made[k].bins, made[k].wide, made[k + 1].bins, made[k + 1].wide, n, m) for k, n, m, _ in pairs]
    frame = spark.createDataFrame(rows, "k int, bins array<bigint>, wide array<bigint>, of_bins array<bigint>, of_wide array<bigint>, n bigint, m bigint")
    left = {r.k for r in frame.where(near_copies.may_be_similar(0.8)).collect()}
    assert all(k in left for k, *_, j in pairs if j >= 0.8) and sum(j >= 0.8 for *_, j in pairs) >= 160
    small = [k for k, n, m, j in pairs if 40 <= n <= 120 and j < 0.78]
    assert len(small) >= 20 and sum(k in left for k in small) <= len(small) // 10


def test_simhash_links_without_any_band(spark):
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join(f"v{k}" for k in range(400)), None, "one word"]
    docs = documents(spark, list(enumerate(texts)))
    keys = row_keys(F.col("doc_id"), F.col("text"))
    rows = near_copies.signature_table(docs, "doc_id", "text", 5, F.struct(*keys).alias("row"))
    sets = rows.withColumn("bands", F.array().cast("array<bigint>"))
    codes = {r.id: r.fp for r in rows.collect()}
    assert (codes[0] ^ codes[1]).bit_count() <= near_copies.DISTANCE and codes[3] == 0

    def contents(wanted):
        return near_copies.set_table(docs, "doc_id", "text", 5, rows.select("s", "row.*").join(wanted, "s"))

    found = near_copies.set_links(sets, contents, 0.8).collect()
    names = {bytes(r.s): r.id for r in rows.collect()}
    assert [{names[bytes(r.node)], names[bytes(r.root)]} for r in found] == [{0, 1}]
