"""Vectors of an array column, packed into blocks that are one row each.

A block holds vectors of one dimension in order of id: ``ids`` and ``values`` are packed little-endian
64-bit numbers. A null id is packed as the largest integer and counts as none.
"""

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NO_ID = np.iinfo(np.int64).max
PACKED = "dim int, ids binary, vectors binary"


class Block(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray

    @classmethod
    def unpack(cls, dim: int, ids: bytes, vectors: bytes) -> "Block":
        own = np.frombuffer(ids, "<i8")
        return cls(own, np.frombuffer(vectors, "<f8").reshape(len(own), dim))


def usable(batch: pa.RecordBatch, zeros: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension: dimension, row numbers, and vectors as doubles.

    A vector that is null or holds null, NaN or infinity is left out, and a zero one unless ``zeros``.
    """
    column = batch.column("vector")
    lengths = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
        vectors = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        good = np.isfinite(vectors).all(axis=1)
        if not zeros:
            good &= (vectors != 0).any(axis=1)
        yield dim, rows[good], vectors[good]


def id_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def pack(rows: int, zeros: bool = True) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs (id, vector) batches of a task into blocks of ``rows`` vectors, the last ones smaller."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(dim: int, all_: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held[dim]])
            vectors = np.concatenate([v for _, v in held[dim]])
            at = 0
            while len(ids) - at >= (1 if all_ else rows):
                order = at + np.argsort(ids[at : at + rows], kind="stable")
                packed = [[dim], [ids[order].astype("<i8").tobytes()], [vectors[order].astype("<f8").tobytes()]]
                kinds = (pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(packed, kinds)], ["dim", "ids", "vectors"])
                at += rows
            held[dim] = [(ids[at:], vectors[at:])]

        for batch in batches:
            ids = id_numbers(batch)
            for dim, own, vectors in usable(batch, zeros):
                held.setdefault(dim, []).append((ids[own], vectors))
                if sum(len(i) for i, _ in held[dim]) >= rows:
                    yield from blocks(dim, False)
        for dim in held:
            yield from blocks(dim, True)

    return run


def hash_of(value: bytes) -> int:
    """Tells apart queries that share an id."""
    return int.from_bytes(blake2b(value, digest_size=8).digest(), "little", signed=True)


class TopLists:
    """The best ``k`` of each query seen so far; ties go to the smaller id. Cut to size now and then."""

    def __init__(self, k: int, score_type: type):
        self.k, self.pending, self.kept, self.cuts = k, 0, 0, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, score_type))]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.pending += len(query)
        if self.pending > max(50_000, 2 * self.kept):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores, best first within a query."""
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        good = np.arange(len(query)) - np.searchsorted(query, query, "left") < self.k
        self.parts = [(query[good], ids[good], scores[good])]
        self.pending, self.kept, self.cuts = 0, len(self.parts[0][0]), self.cuts + 1
        return self.parts[0]

    def least(self, queries: int) -> np.ndarray:
        """The ``k``-th best score of each query when lists were last cut, -inf where there were fewer."""
        query, _, scores = self.parts[0]
        out = np.full(queries, -np.inf)
        last = np.arange(len(query)) - np.searchsorted(query, query, "left") == self.k - 1
        out[query[last]] = scores[last]
        return out


def best_of_tile(scores: np.ndarray, allowed: np.ndarray, k: int, slack: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best allowed scores; columns are in order of id.

    With ``slack`` everything less than that below the k-th best is returned too.
    """
    lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    scores = np.where(allowed, scores, lowest)
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        if slack:
            good = scores >= least - slack
        else:
            equal = scores == least
            above = scores > least
            good = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        good &= allowed
    else:
        good = allowed
    return np.nonzero(good)
