"""Byte-level byte-pair encoding and decoding with a public rank file.

Texts are split by the vocabulary's pattern and every distinct piece is merged once per chunk.
Pieces are laid out as padded matrices, one per length bucket. In each round every row looks up
the ranks of its adjacent pairs (a hash table of pairs held in two arrays), merges its leftmost
pair of least rank and closes the gap; finished rows leave the matrix. A piece wider than the
widest bucket takes the same merges through a heap, as a matrix would need its squared length.

Defined results: a null text counts as empty; an empty text has no tokens; rows are encoded one by
one, so ties, repeated rows and null ids change nothing; other columns are not looked at.
"""

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import id_type, shared_value, small_batches, trimmed
from ._text import CHUNK, chunks

NONE = np.int32(2**31 - 1)
#: Widths of the matrices; wider pieces use a heap.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
#: Characters of pieces a task remembers before it starts anew; results do not depend on it.
REMEMBERED = 8_000_000


class PairTable:
    """Open addressing: the rank of a pair of token ids, NONE for pairs that never merge."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes, left = 0, np.arange(len(pairs))
        slots = self.home(pairs)
        while len(left):
            free = left[self.keys[slots[left]] == -1]
            taken, first = np.unique(slots[free], return_index=True)
            self.keys[taken], self.ranks[taken] = pairs[free[first]], ranks[free[first]]
            left = left[self.keys[slots[left]] != pairs[left]]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id is padding and merges with nothing."""
        keys = (left.astype(np.int64) << 32) | right
        shape, keys = keys.shape, keys.ravel()
        out = np.full(len(keys), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self.home(keys[todo])
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            todo, slots = todo[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Vocabulary:
    """Ranks of byte strings, the pairs that make each, and the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        pairs, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    made.append(rank)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(made, np.int32))
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")

    @classmethod
    def load(cls, path: str, pattern: str) -> "Vocabulary":
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def merge_matrix(ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix (-1 is padding) to its tokens; the matrix and tokens per row."""
    out = np.full(ids.shape, -1, np.int32)
    rows, ranks = np.arange(len(ids)), pairs.lookup(ids[:, :-1], ids[:, 1:])
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
        done = best == NONE
        if done.any():
            out[rows[done], : ids.shape[1]] = ids[done]
            rows, ids, ranks, best, at = rows[~done], ids[~done], ranks[~done], best[~done], at[~done]
        if not len(rows):
            break
        each, width = np.arange(len(rows)), ids.shape[1]
        ids[each, at] = best
        places = np.arange(width - 1)
        ids = np.where(places > at[:, None], ids[:, 1:], ids[:, :-1])
        ranks = np.where(places[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1])
        for shift in (-1, 0):  # the pairs at both sides of the new token
            pair = at + shift
            k = np.flatnonzero((pair >= 0) & (pair < width - 2))
            ranks[k, pair[k]] = pairs.lookup(ids[k, pair[k]], ids[k, pair[k] + 1])
    return out, (out >= 0).sum(axis=1)


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The same merges for one long row: least rank first, then leftmost, from a heap."""
    token, n, none = ids.tolist(), len(ids), int(NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [*pairs.lookup(ids[:-1], ids[1:]).tolist(), none]
    heap = [(r, i) for i, r in enumerate(rank_at) if r != none]
    heapq.heapify(heap)
    known: dict[tuple[int, int], int] = {}

    def rank(i: int) -> None:
        j = after[i]
        pair = (token[i], token[j]) if j < n else (-1, -1)
        if pair not in known:
            known[pair] = int(pairs.lookup(np.array(pair[:1]), np.array(pair[1:]))[0])
        rank_at[i] = known[pair]
        if rank_at[i] != none:
            heapq.heappush(heap, (rank_at[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if token[i] < 0 or rank_at[i] != r:
            continue
        j = after[i]
        token[i], token[j], rank_at[j] = r, -1, none
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        rank(i)
        if before[i] >= 0:
            rank(before[i])
    return np.array([t for t in token if t >= 0], np.int32)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Token ids of each piece as little-endian 32-bit numbers."""
    out = [b""] * len(pieces)
    widths: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            out[k] = whole.to_bytes(4, "little")
        else:
            widths.setdefault(next((w for w in WIDTHS if len(piece) <= w), 0), []).append(k)
    for width, own in widths.items():
        if width:
            data = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in own), np.uint8).reshape(-1, width)
            ids = vocabulary.single[data]
            ids[np.arange(width) >= np.array([len(pieces[k]) for k in own])[:, None]] = -1
            merged, counts = merge_matrix(ids, vocabulary.pairs)
            laid = merged.astype("<u4").tobytes()
            for k, begin, n in zip(own, range(0, len(laid), 4 * width), counts.tolist()):
                out[k] = laid[begin : begin + 4 * n]
        else:
            for k in own:
                ids = vocabulary.single[np.frombuffer(pieces[k], np.uint8)]
                out[k] = merge_long(ids, vocabulary.pairs).astype("<u4").tobytes()
    return out


def encode_texts(texts: Iterable[str], vocabulary: Vocabulary, known: dict[str, bytes]) -> Iterator[bytes]:
    """Ids of each text; ``known`` holds pieces already merged and is added to."""
    split = regex.compile(vocabulary.pattern).findall
    pieces = [split(text) for text in texts]
    new = list(set().union(*pieces).difference(known)) if pieces else []
    known.update(zip(new, encode_pieces([piece.encode() for piece in new], vocabulary)))
    for own in pieces:
        yield b"".join(map(known.__getitem__, own))


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK // 2
) -> DataFrame:
    """Encode whole texts, and decode the ids again.

    Returns ``id_col``, ``n_tokens``, ``token_ids`` (binary, little-endian unsigned 32-bit) and
    ``decoded`` (binary, the bytes the ids stand for). ``path`` is read on the driver; the
    vocabulary is bounded and broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_value(spark, Vocabulary.load(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = shared(), {}
        kept = 0
        for table in chunks(batches, "text", chunk):
            if kept > REMEMBERED:
                known, kept = {}, 0
            had = len(known)
            texts = (text or "" for text in table["text"].to_pylist())
            ids = list(encode_texts(texts, vocabulary, known))
            kept += table["text"].nbytes if len(known) > had else 0
            tokens = vocabulary.bytes.__getitem__
            decoded = [b"".join(map(tokens, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks() if table.num_rows else pa.array([], table["id"].type),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.binary()),
                ],
                ["id", "n_tokens", "token_ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = id_type(docs, id_col)
    done = rows.mapInArrow(trimmed(run), f"id {kind}, n_tokens bigint, token_ids binary, decoded binary")
    return done.withColumnRenamed("id", id_col)
