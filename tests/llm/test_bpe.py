"""Token ids equal to those of the library, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyshelf.llm import bpe, queries

from .helpers import clashing, documents, rows

with open(queries.RANKS, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(queries.RANKS, public_tokenizers.PATTERN)


def packed(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()


def test_ids_equal_the_library(vocabulary):
    rng = random.Random(1)
    letters = [" ", "a", "b", "é", "\n", "\t", "'", "s", "0", "9", "中", "̀", "😀", "\x00", "\x85", "_", "-"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["a" * n for n in range(1, 400)] + ["ab" * 1000 + "é" * 700, " " * 900, "<|endoftext|>", "don't I'll", "\r\n\r\n x"]
    assert list(bpe.encode_texts(texts, vocabulary, {})) == [packed(t) for t in texts]


def test_heap_and_matrix_agree(vocabulary):
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randrange(2, 120)))
        ids = vocabulary.single[np.frombuffer(piece, np.uint8)]
        merged, counts = bpe.merge_matrix(ids[None].copy(), vocabulary.pairs)
        assert merged[0, : counts[0]].tolist() == bpe.merge_long(ids, vocabulary.pairs).tolist()


def test_pairs_are_found(vocabulary):
    keys = np.array([1 << 32 | 2, 7 << 32 | 7])
    table = bpe.PairTable(keys, np.array([5, 6], np.int32))
    assert table.lookup(np.array([1, 7, 2, -1]), np.array([2, 7, 1, 2])).tolist() == [5, 6, bpe.NONE, bpe.NONE]


def test_documents(spark):
    docs = [(1, "Hello  wörld"), (2, None), (3, ""), (4, "x" * 50_000), (4, "x" * 50_000), (None, "don't"), (5, "the cat " * 30_000)]
    got = bpe.encode(clashing(documents(spark, docs)), queries.RANKS, public_tokenizers.PATTERN)
    want = [(d, len(packed(t)) // 4, packed(t), (t or "").encode()) for d, t in docs]
    found = [(r.doc_id, r.n_tokens, bytes(r.token_ids), bytes(r.decoded)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert bpe.encode(documents(spark, []), queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    digest = lambda x: hashlib.sha256(x).hexdigest()
    table = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r.doc_id, len(packed(r.text)) // 4, digest(packed(r.text)), digest(r.text.encode())) for r in table]
    assert rows(queries.op10_bpe(spark, sf)) == sorted(want, key=repr)
