"""Phrases and template blocks against a plain loop over all blocks and templates."""

import math
import random
import re

from tallyshelf.llm import licenses, queries

from .helpers import clashing, documents, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, threshold=0.8, block=64, templates=licenses.TEMPLATES):
    out = []
    for doc, text in docs:
        words = words_of(text)
        starts, base, found = [], set(), []
        for phrase, label in licenses.PHRASES.items():
            parts = phrase.split()
            here = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            starts += here
            base |= {label} if here else set()
        for b in range(0, len(words), block // 2):
            held = set(words[b : b + block])
            for t, label in templates:
                share = len(held & set(t.split())) / len(set(t.split()))
                if len(held & set(t.split())) >= math.ceil(threshold * len(set(t.split())) - 1e-9):
                    found.append((label, b, share))
        score = 1.0 if base else max((f[2] for f in found), default=0.0)
        labels = ",".join(sorted(base | {f[0] for f in found}))
        first, last = (min(starts), max(starts)) if starts else (None, None)
        out.append((doc, len(words), len(starts), first, last, ",".join(sorted(base)), labels, score, sorted(found)))
    return sorted(out, key=repr)


def got(df):
    plain = [(*r[:8], sorted((m.label, m.first, m.containment) for m in r.blocks)) for r in df.collect()]
    return sorted(plain, key=repr)


def texts(rng):
    filler = ["the", "of", "software", "license", "under", "is", "a", "free", "copy", "word", "ünder", "it", "this", "public", "use"]
    docs = []
    for i in range(150):
        parts = [rng.choice(filler) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(licenses.TEMPLATES)[0].split()
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(filler)
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = t if rng.random() < 0.8 else rng.choice(list(licenses.PHRASES)).split()
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(parts)))
    return docs


ODD = [
    (500, None), (501, ""), (502, " \n!"), (503, "CC-BY 4.0"), (503, "CC-BY 4.0"), (None, "MIT License"), (504, "MIT\x00License"),
    (505, "mit licenses"), (506, "GNU General Public License GNU GENERAL PUBLIC LICENSE, Apache license"), (507, "xcc by"),
    (508, "cc"), (509, "by cc by"), (510, "the license " * 30_000 + "mit license"), (511, "x" * 100_000), (512, "éCC BY cc byé"),
]


def test_equals_a_plain_loop(spark):
    docs = texts(random.Random(1)) + ODD
    assert got(licenses.scan(clashing(documents(spark, docs)))) == expected(docs)


def test_other_thresholds_and_blocks(spark):
    docs = texts(random.Random(2)) + ODD
    for threshold, block in ((0.5, 16), (1.0, 40)):
        assert got(licenses.scan(documents(spark, docs), threshold=threshold, block=block)) == expected(docs, threshold, block)


def test_whole_table_has_its_phrases(spark):
    sf = "/root/testdata/sf0.01"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [r[:8] for r in expected(table)]
    assert rows(queries.op4_licenses(spark, sf)) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 30


def test_empty_table(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
