"""Words of whole Arrow text columns, found and hashed with numpy."""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 8 << 20
#: Bytes of text worked on at a time where arrays over words are many times as large, and stay with the worker.
PART = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(separators: Iterable[int]) -> np.ndarray:
    """True for bytes that belong to words. Bytes from 0x80 on are parts of letters."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
ALPHANUMERIC = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A byte's lower case, A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Masks that keep the first n of eight bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[pa.Table]:
    """The same rows in tables of about ``most`` bytes of text; one longer row makes its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            to = max(int(np.searchsorted(total, before + most - size, "right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - before
                at = to
            if at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Words(NamedTuple):
    """The words of n texts: word i is data[starts[i]:ends[i]], text j has words first[j]:first[j + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no rows
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(column: pa.Array | pa.ChunkedArray, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """64 bits of each word's bytes, taken eight at a time."""
    data, starts, ends, _ = words
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) + np.uint64(seed) * GOLDEN)
    open_, at = np.arange(len(starts)), starts
    while len(open_):
        lane = eights[at] & KEEP[np.minimum(left, 8)]
        out[open_] = mix((out[open_] ^ lane) * GOLDEN + np.uint64(1))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return out


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of longer windows from those of two parts."""
    return mix(left * GOLDEN + (right ^ (right >> np.uint64(32))) + np.uint64(0x632BE59BD9B4E019))


def window_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` units, each built from windows of half its length."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, units, 1
    while True:
        if length & size:
            out = power if out is None else join_hashes(out[: len(power) - have] if have else out, power[have:])
            have += size
        if have == length:
            return out[:n]
        power = join_hashes(power[:-size], power[size:])
        size *= 2


class Joined(NamedTuple):
    """Words joined by one space: the k-th begins at begins[k], text j is data[offsets[j]:offsets[j + 1]]."""

    data: np.ndarray
    begins: np.ndarray
    offsets: np.ndarray

    def strings(self) -> pa.Array:
        parts = [None, pa.py_buffer(self.offsets.astype(np.int64).tobytes()), pa.py_buffer(self.data.tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(self.offsets) - 1, parts).cast(pa.string())


def join_words(words: Words, keep: np.ndarray | None = None) -> Joined:
    """The words of each text, or those of them that ``keep`` marks, joined by one space."""
    starts, ends, first = words.starts, words.ends, words.first
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
        first = np.concatenate([[0], np.cumsum(keep)])[first]
    lengths = ends - starts + 1
    last = first[1:][np.diff(first) > 0] - 1
    lengths[last] -= 1  # no space after the last word
    to = np.concatenate([[0], np.cumsum(lengths)])
    data = np.full(int(to[-1]), 0x20, np.uint8)
    place = np.arange(len(data)) - np.repeat(to[:-1], lengths)
    inside = place < np.repeat(ends - starts, lengths)
    data[inside] = words.data[(np.repeat(starts, lengths) + place)[inside]]
    return Joined(data, to[:-1], to[first])
