"""Remove word windows that occur more than once, by level-wise doubling.

Levels have window lengths that double from ``window / 4`` up to ``window``. A window of the full
length stands, at the first level, for the shorter window in it whose hash is least (its anchor),
so neighbouring windows mostly share one and only few are sent. Windows repeated at one length
alone are extended to twice that length, inside the full window; equal full windows have equal
anchors and extensions, so none is lost. Levels end when the full length is reached, or when no
candidate survives. The last level decides on every full window itself.

A level sends, for each chunk of text and each hash bucket, one row of packed hashes and places.
A hash that occurs several times in a chunk is settled there and sent once, as a witness, so a
passage that millions of documents share costs one hash per chunk, however often it occurs. A
bucket compares hashes in one task; ``buckets`` follows the number of shuffle partitions.
Surviving places go back to the documents by a join on 128 bits of a row's id and text; the
shuffle of the documents serves all levels.

Windows are compared by 64-bit hashes at each of the levels; two different windows of the last
level count as equal with a chance of 2^-64 a pair.

Defined results: a null, empty or short text has nothing removed; ``kept`` is empty for a null
text. Repeated rows are documents of their own: they repeat each other and get the same result.
A null id stays null. Other columns are not looked at. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import id_type, partitions, row_keys, small_batches
from ._text import SPACED, Words, chunks, find_words, join_hashes, join_words, window_hashes, word_hashes

SENT = "bucket int, hashes binary, runs binary, places binary, witnesses binary, done binary"
MARKS = "k1 bigint, k2 bigint, marks binary"


def level_lengths(window: int, seed: int) -> list[int]:
    """Window lengths: ``seed``, doubled as long as that is shorter than ``window``, and ``window``."""
    out = [min(seed, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each place, where the least of the next ``span`` hashes is; the first one of equals."""
    bits = np.uint64(max(len(hashes), 2).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (least & low).astype(np.int64)


class Windows:
    """The full windows of a chunk's texts that are candidates at a level, and what they stand for."""

    def __init__(self, words: Words, lengths: list[int], level: int, alive: list | None):
        window = lengths[-1]
        units = word_hashes(words)
        self.first, total = words.first, len(units)
        self.starts = self.tests = self.anchor = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        if total < window:
            return
        seeds = window_hashes(units, lengths[0])
        anchor = anchors(seeds, window - lengths[0] + 1)
        starts = np.arange(total - window + 1)
        text = np.searchsorted(words.first, starts, "right") - 1
        good = starts + window <= words.first[text + 1]
        tests = anchor
        for k in range(1, level + 1):
            if k == level:  # those whose window of the level before was repeated
                flags = np.zeros(total, bool)
                for at, marks in zip(words.first.tolist(), alive):
                    if marks:
                        flags[at + run_places(b"".join(marks))] = True
                good &= flags[tests]
            tests = np.minimum(tests, starts + window - lengths[k])
        starts, tests, anchor = starts[good], tests[good], anchor[good]
        new = np.ones(len(starts), bool)
        new[1:] = (tests[1:] != tests[:-1]) | (anchor[1:] != anchor[:-1])
        self.starts, self.tests, self.anchor = starts[new], tests[new], seeds[anchor[new]]
        if len(self.tests):
            self.hashes = join_hashes(window_hashes(units, lengths[level])[self.tests], self.anchor)


def run_places(packed: bytes) -> np.ndarray:
    """Places from packed runs (start, count)."""
    runs = np.frombuffer(packed, "<i4").reshape(-1, 2).astype(np.int64)
    counts = runs[:, 1]
    return np.repeat(runs[:, 0] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def runs_of(breaks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive places: index of the first, its place, and how many; ``breaks`` ends runs."""
    begin = np.ones(len(places), bool)
    begin[1:] = breaks | (places[1:] != places[:-1] + 1)
    at = np.flatnonzero(begin)
    return at, places[at], np.diff(np.append(at, len(places)))


def packed_column(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of ``counts`` items each, taken one after another from ``data``."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * (data.itemsize * (data.shape[1] if data.ndim > 1 else 1))
    buffers = [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


def sent_rows(found: Windows, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: hashes that are single in the chunk with their places, and settled ones.

    ``places`` holds the keys of the texts, and ``runs`` and ``done`` are (text, start, count), with
    the text's number among the row's keys.
    """
    text = np.searchsorted(found.first, found.tests, "right") - 1
    place = found.tests - found.first[text]
    _, inverse, times = np.unique(found.hashes, return_inverse=True, return_counts=True)
    single = times[inverse] == 1
    witness = np.zeros(len(single), bool)
    witness[np.unique(inverse, return_index=True)[1]] = True
    witness &= ~single
    of_hash = (found.anchor % np.uint64(buckets)).astype(np.int64) if len(found.anchor) else np.zeros(0, np.int64)
    of_text = (keys[text, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64) if len(text) else of_hash
    bucket = np.where(single, of_hash, of_text)
    order = np.argsort(bucket, kind="stable")
    order = order[np.lexsort((~single[order], bucket[order]))]  # settled ones first in each bucket
    b, t, p, s = bucket[order], text[order], place[order], single[order]
    at, start, count = runs_of((b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1]), p)
    rb, rt, rs = b[at], t[at], s[at]
    pairs, number = np.unique(rb * (len(keys) + 1) + rt, return_inverse=True)
    pair_bucket = pairs // (len(keys) + 1)
    seen = np.unique(np.concatenate([b, of_hash[witness]]))
    first_pair = np.searchsorted(pair_bucket, seen)
    run = np.stack([number - first_pair[np.searchsorted(seen, rb)], start, count], axis=1).astype("<i4")

    def each(of: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(of, np.append(seen, buckets)))

    by = np.argsort(of_hash[witness], kind="stable")
    columns = [
        pa.array(seen.astype(np.int32)),
        packed_column(found.hashes[order[s]], each(b[s])),
        packed_column(run[rs], each(rb[rs])),
        packed_column(keys[pairs % (len(keys) + 1)], each(pair_bucket)),
        packed_column(found.hashes[witness][by], each(of_hash[witness][by])),
        packed_column(run[~rs], each(rb[~rs])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "hashes", "runs", "places", "witnesses", "done"])


def repeated(table: pa.Table) -> pa.Table:
    """Places of one bucket's repeated windows, by text."""
    out = []
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    witnesses = np.frombuffer(b"".join(table["witnesses"].to_pylist()), np.uint64)
    _, inverse, times = np.unique(np.concatenate([hashes, witnesses]), return_inverse=True, return_counts=True)
    again = times[inverse[: len(hashes)]] > 1
    at = 0
    for runs, keys, done in zip(*(table[c].to_pylist() for c in ("runs", "places", "done"))):
        runs = np.frombuffer(runs, "<i4").reshape(-1, 3)
        text = np.repeat(runs[:, 0], runs[:, 2])
        place = run_places(np.ascontiguousarray(runs[:, 1:]).tobytes())
        hit = again[at : at + len(place)]
        at += len(place)
        text, place = text[hit], place[hit]
        first, start, count = runs_of(text[1:] != text[:-1], place)
        found = np.concatenate([np.stack([text[first], start, count], axis=1), np.frombuffer(done, "<i4").reshape(-1, 3)])
        found = found[np.argsort(found[:, 0], kind="stable")].astype("<i4")
        texts, counts = np.unique(found[:, 0], return_counts=True)
        key = np.frombuffer(keys, "<i8").reshape(-1, 2)[texts]
        marks = packed_column(np.ascontiguousarray(found[:, 1:]), counts)
        out.append(pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), marks], ["k1", "k2", "marks"]))
    return pa.Table.from_batches(out)


def repeated_windows(docs: DataFrame, window: int, seed: int, buckets: int) -> DataFrame:
    """``k1``, ``k2``, ``marks``: packed runs of the starts of repeated windows of each text.

    ``docs`` has ``k1``, ``k2``, ``id`` and ``text``.
    """
    lengths = level_lengths(window, seed)
    marks = None
    for level in range(len(lengths)):

        def send(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for table in chunks(batches, "text"):
                alive = table["marks"].to_pylist() if level else None
                found = Windows(find_words(table["text"], SPACED), lengths, level, alive)
                keys = np.stack([table["k1"].to_numpy(), table["k2"].to_numpy()], axis=1)
                yield sent_rows(found, keys, buckets)

        rows = docs.select("k1", "k2", "text") if marks is None else docs.join(marks, ["k1", "k2"])
        sent = rows.mapInArrow(send, SENT)
        marks = sent.groupBy("bucket").applyInArrow(repeated, MARKS)
        marks = marks.groupBy("k1", "k2").agg(F.collect_list("marks").alias("marks"))
    return marks


def remove_repeats(
    docs: DataFrame,
    window: int = 35,
    seed: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """``id_col``, ``kept`` (the words left, joined by one space), ``n_words`` and ``n_removed``.

    A word is removed if it lies in a window of ``window`` words whose words also stand, in that
    order, at another place of any document. ``seed``: window length of the first level.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = id_type(docs, id_col)
    rows = docs.select(*row_keys(F.col(id_col), F.col(text_col)), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = repeated_windows(rows, window, seed or -(-window // 4), buckets or 4 * partitions(spark))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text"):
            words = find_words(table["text"], SPACED)
            edge = np.zeros(len(words.starts) + window + 1, np.int64)
            for at, marks in zip(words.first.tolist(), table["marks"].to_pylist()):
                if marks:
                    starts = np.unique(at + run_places(b"".join(marks)))
                    edge[starts] += 1
                    edge[starts + window] -= 1
            left = np.cumsum(edge)[: len(words.starts)] == 0
            kept = np.diff(np.concatenate([[0], np.cumsum(left)])[words.first])
            columns = [table["id"].combine_chunks(), join_words(words, left).strings(), words.counts(), words.counts() - kept]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["id", "kept", "n_words", "n_removed"])

    done = rows.join(marks, ["k1", "k2"], "left").mapInArrow(keep, f"id {kind}, kept string, n_words bigint, n_removed bigint")
    return done.withColumnRenamed("id", id_col)
