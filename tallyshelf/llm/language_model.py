"""Scores of texts under an online logistic mix of hashed-context bit predictors.

A text's tokens are its words and an end. A word is spelled byte by byte and closed, a byte is a path in
a Huffman tree of the corpus's bytes, and each step of a path is a bit to predict:

* Predictors. Five contexts of a bit (its place in the tree alone, with one, two or three bytes before it,
  with all of the word so far) are hashed into tables of counts of zeros and ones. Counts are sums
  over every training token, taken from the corpus-wide counts of words: a word that occurs c times is spelled
  once and counts c times. Each table's logit log((ones + d) / (zeros + d)) is an input of the mix.
* Mix. A weight for each input, of a set that the place in the word and the experience of the longest
  context select. Weights are learned online from all training tokens: words are dealt to batches by a hash, and each
  batch moves the weights by a Newton step with the curvature of all batches so far, so a batch is two sums that tasks
  add up. Steps on all training tokens follow until one gains less than a ten-thousandth of a nat a token. A token's own
  occurrence is left out of the counts it meets.
* Refinement. Within a document an adaptive map adds to each mixed logit what this document's bits
  so far say: a cell for each weight set and step of the logit, moved after each block of words by its
  errors over the curvature it has seen. So blocks are predicted from earlier ones only, and the
  probabilities of all texts add up to at most one.

All contexts lie within a word; what connects the words of a text is the refinement.

Documents are packed into rows of some megabytes of text that hold their distinct words once. These are dealt to
parts by a hash, a part's words of all rows are counted together, and counts return by a cogroup, so no vocabulary is
broadcast; the model that is broadcast has a size set by ``sizes``.

Defined results: a null or empty text has the end token alone. Rows are scored one by one; a repeated
row counts again in what is learned. A row whose ``held_out`` is null is not held out and teaches
nothing. Without training rows every token is unknown and the model knows bytes by their number alone.
Other columns are not looked at.
"""

import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyshelf.session import settle

from ._frames import id_type, partitions, shared_value, small_batches
from ._text import CHUNK, GOLDEN, LOWER, SPACED, Words, chunks, find_words, mix, text_bytes, word_hashes

#: Symbols no word has: what closes a word, and the end of a text.
CLOSE, END = 0x20, 0x0A
ORDERS = 5
SEEDS = np.arange(ORDERS + 1, dtype=np.uint64) * GOLDEN
#: Counts of the longest context at which its experience is of the next kind.
EXPERIENCE = np.array([1, 2, 4, 8, 32, 128, 1024])
#: Weight sets: places in a word (first, second, later) by experience of the longest context.
GATES = 3 * (len(EXPERIENCE) + 1)
#: Steps of the mixed logit, and cells of a document's refinement.
STEPS = np.array([-6.0, -3.0, -1.0, 0.0, 1.0, 3.0, 6.0], np.float32)
CELLS = GATES * (len(STEPS) + 1)
#: Words of a block; what a cell's curvature starts from; share of a count that is given beforehand.
BLOCK, PRIOR, BEFORE = 64, 10.0, 0.1
#: Slots of a piece of a table on its way through a shuffle; words and tokens worked on at a time, so few that their bits stay in a cache.
PIECE, SOME = 4096, 2_000
#: Distinct words of chunks that are counted together, about.
TOGETHER = 1_000_000
#: Words are dealt to so many parts by a hash; the weights first move once on each of these batches of parts.
PARTS, BATCHES = 8, ((0, 1), (1, 3), (3, 8))
#: Nats a token that the last step on all parts gains at most.
GAIN = 1e-4
LARGEST = 60_000.0
#: No mixed logit is further from zero.
MOST = np.float32(40)
LN2, LN10 = float(np.log(2)), float(np.log(10))


SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Tree(NamedTuple):
    """Huffman paths: symbol s takes steps first[s]:first[s + 1], each a node and a bit."""

    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "Tree":
        """Every symbol has a path; ties go to the symbol or node made first."""
        heap = [(float(n) + 1.0, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        above, made = {}, len(counts)
        while len(heap) > 1:
            (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a], above[b] = (made, 0), (made, 1)
            heapq.heappush(heap, (m + n, made))
            made += 1
        paths = []
        for s in range(len(counts)):
            path = []
            while s in above:
                s, bit = above[s]
                path.append((s - len(counts), bit))
            paths.append(path[::-1])
        steps = np.array([step for path in paths for step in path], np.int64)
        return cls(np.concatenate([[0], np.cumsum([len(p) for p in paths])]), steps[:, 0].astype(np.uint64), steps[:, 1].astype(bool))


class Spelled(NamedTuple):
    """Words as symbols: word w has symbols first[w]:first[w + 1], at these places in it."""

    symbols: np.ndarray
    first: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, end: bool = False) -> "Spelled":
        """Spell words, and the end of a text after them if ``end``."""
        lengths = np.diff(offsets) + 1
        first = np.concatenate([[0], np.cumsum(lengths)])
        symbols = np.full(int(first[-1]) + end, CLOSE, np.uint8)
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = data
        if end:
            symbols[-1] = END
            lengths, first = np.append(lengths, 1), np.append(first, first[-1] + 1)
        return cls(symbols, first, np.arange(len(symbols)) - np.repeat(first[:-1], lengths))

    def merged(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols but those that the word before has too, after the same beginning; and how often each occurs, if words do ``counts`` times.

        Contexts lie within a word, so what is left out has the same ones as what it is counted with.
        """
        lengths = np.diff(self.first)
        if not len(lengths):
            return np.zeros(0, np.int64), np.zeros(0)
        back = np.repeat(np.append(0, lengths[:-1]), lengths)
        like = (self.place < back) & (self.symbols == self.symbols[np.maximum(np.arange(len(back)) - back, 0)])
        shared = np.minimum.reduceat(np.where(like, len(back), self.place), self.first[:-1])
        order = np.argsort(self.place, kind="stable")
        new = (self.place >= np.repeat(shared, lengths))[order]
        return order[new], np.bincount(np.cumsum(new) - 1, np.repeat(counts, lengths)[order])

    def contexts(self) -> list[np.ndarray]:
        """A hash of each context of each symbol."""
        symbols, place = self.symbols.astype(np.uint64), self.place
        out, near = [], np.zeros(len(symbols), np.uint64)
        for k in range(ORDERS - 1):
            if k:
                before = np.zeros(len(symbols), np.uint64)
                before[k:] = symbols[:-k] + np.uint64(1)
                near = near | np.where(place >= k, before, np.uint64(0)) << np.uint64(9 * (k - 1))
            out.append(mix(near + SEEDS[k]))
        total = np.cumsum(mix(symbols + (place.astype(np.uint64) << np.uint64(8))))
        so_far = np.concatenate([np.zeros(1, np.uint64), total])[:-1]
        so_far -= np.repeat(so_far[self.first[:-1]], np.diff(self.first))
        out.append(mix(so_far + SEEDS[ORDERS]))
        return out


class Bits(NamedTuple):
    """The bits of words: word w (or symbol w, if but some are kept) has first[w]:first[w + 1]. Slots are made for one order at a time.

    A slot is the beginning of (context + (node + 1) * GOLDEN) * SPREAD; both summands are multiplied beforehand.
    """

    first: np.ndarray
    symbol: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    contexts: list[np.ndarray]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, words: Spelled, tree: Tree, sizes: tuple[int, ...], kept: np.ndarray | None = None) -> "Bits":
        symbols = words.symbols if kept is None else words.symbols[kept]
        lengths = np.diff(tree.first)[symbols]
        ends = np.cumsum(lengths)
        symbol = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(symbol)) + np.repeat(tree.first[symbols] - (ends - lengths), lengths)
        first = np.concatenate([[0], ends])
        first = first[words.first] if kept is None else first
        nodes = (tree.nodes + np.uint64(1)) * GOLDEN * SPREAD
        return cls(first, symbol, nodes.take(step), tree.bits.take(step), [(c if kept is None else c[kept]) * SPREAD for c in words.contexts()], sizes)

    def slots(self, order: int) -> np.ndarray:
        hashed = self.contexts[order].take(self.symbol)
        hashed += self.node
        hashed >>= np.uint64(64 - self.sizes[order])
        return hashed.view(np.int64)


class Model(NamedTuple):
    """Tree, bits of each order's slot numbers, counts by order, bit and slot, and weights of each set (inputs, then a constant)."""

    tree: Tree
    sizes: tuple[int, ...]
    counts: list[np.ndarray]
    weights: np.ndarray


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(BEFORE)) / (zeros + np.float32(BEFORE)))


def steps_below(x: np.ndarray, steps: np.ndarray, too: bool = False) -> np.ndarray:
    """How many of a few steps are below each value, or as large too."""
    out = np.zeros(len(x), np.uint8)
    for step in steps:
        out += (x >= step) if too else (x > step)
    return out


def gates(kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.minimum(place, 2) * (len(EXPERIENCE) + 1) + kind


class Mixed:
    """Logits, cells and values of the bits of words, given the corpus alone."""

    def __init__(self, model: Model):
        self.tree, self.sizes, self.weights = model.tree, model.sizes, model.weights
        self.columns = [np.ascontiguousarray(column) for column in model.weights.T]
        self.kinds = steps_below(model.counts[-1].sum(axis=0, dtype=np.float32), EXPERIENCE, too=True)
        self.tables = [logits(*own.astype(np.float32)) for own in model.counts]

    def of(self, data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First bit of each word; and each bit's logit, cell, and whether it is a one."""
        steps = np.diff(self.tree.first)
        n = int(steps[data].sum() + steps[CLOSE] * (len(offsets) - 1) + steps[END] * end)
        logit, cell, one = np.empty(n, np.float32), np.empty(n, np.uint8), np.empty(n, bool)
        firsts, at = [], 0
        for begin in range(0, max(1, len(offsets) - 1), SOME):
            cut = offsets[begin : begin + SOME + 1]
            last = begin + SOME >= len(offsets) - 1
            words = Spelled.of(data[cut[0] : cut[-1]], cut - cut[0], end and last)
            bits = Bits.of(words, self.tree, self.sizes)
            firsts.append(bits.first[:-1] + at)
            own = slice(at, at := at + len(bits.bit))
            slots = bits.slots(ORDERS - 1)
            gate = gates(self.kinds.take(slots), words.place.take(bits.symbol))
            z = self.columns[ORDERS].take(gate)
            for k in reversed(range(ORDERS)):
                x = self.tables[k].take(bits.slots(k) if k < ORDERS - 1 else slots)
                x *= self.columns[k].take(gate)
                z += x
            np.clip(z, -MOST, MOST, out=z)
            logit[own], one[own] = z, bits.bit
            cell[own] = gate * (len(STEPS) + 1) + steps_below(z, STEPS)
        return np.append(np.concatenate(firsts), at), logit, cell, one


def refine(mixed: tuple, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Nats of each document: tokens ``words`` (numbers of words), ``counts`` of them a document."""
    first, z, cell, one = mixed
    lengths = np.diff(first)
    docs = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    block = place // BLOCK
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
    nats = np.zeros(len(counts))
    # a cell's shift, negative for zeros and positive for ones, so that it is looked up with its sign
    shift = np.zeros((len(counts), CELLS, 2), np.float32)
    curvature = np.full((len(counts), CELLS), PRIOR)
    kind = cell.astype(np.int16) * 2 + one
    odds = np.where(one, -z, z)
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        texts, of_text = np.unique(docs[order[start:stop]], return_inverse=True)
        now, width = shift[texts].ravel(), 2 * CELLS
        miss, curve = np.zeros(len(now)), np.zeros(len(now))
        for at in range(start, stop, SOME):
            own = slice(at - start, min(at + SOME, stop) - start)
            word = words[order[start:stop][own]]
            size = lengths[word]
            begins = np.cumsum(size) - size
            bit = np.repeat(first[word] - begins, size)
            bit += np.arange(len(bit))
            low, high = int(of_text[own][0]), int(of_text[own][-1]) + 1
            some = slice(low * width, high * width)
            key = np.repeat((of_text[own] - low) * width, size)
            key += kind.take(bit)
            e = odds.take(bit)
            e -= now[some].take(key)
            np.exp(e, out=e)
            both = e + np.float32(1)
            nats[texts[low:high]] += np.bincount(of_text[own] - low, np.add.reduceat(np.log(both), begins))
            e /= both
            miss[some] += np.bincount(key, e, (high - low) * width)
            e /= both
            curve[some] += np.bincount(key, e, (high - low) * width)
        miss, curve = miss.reshape(-1, CELLS, 2), curve.reshape(-1, CELLS, 2)
        curvature[texts] += curve.sum(axis=2)
        moved = ((miss[:, :, 1] - miss[:, :, 0]) / curvature[texts]).astype(np.float32)
        shift[texts] += np.stack([-moved, moved], axis=2)
    return nats


def packed_documents(docs: DataFrame, held_out: Column, teaches: Column, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Rows of many documents: their ids and numbers of words, the words as numbers, and distinct words once."""
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), teaches.alias("teaches"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", chunk):
            if not table.num_rows:
                continue
            words = find_words(table["text"], SPACED, lower=True)
            data, _ = text_bytes(table["text"])
            offsets = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
            flat = LOWER[data][SPACED[data]]
            parts = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())]
            coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, parts).dictionary_encode()
            distinct, code = coded.dictionary, coded.indices.to_numpy().astype("<i4")
            taught = np.repeat(table["teaches"].to_numpy(), words.counts())
            n = np.bincount(code[taught], minlength=len(distinct)).astype("<i4")
            small = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
            lengths = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype("<i4")
            held = b"".join(distinct.to_pylist())
            one = {
                "chunk": [uuid4().int >> 65],
                "ids": [table["id"].to_pylist()],
                "held_out": [table["held_out"].to_pylist()],
                "counts": [words.counts().tolist()],
                "n_code": [len(code)],
                "code": [small(code)],
                "taught": [small(n)],
                "lengths": [small(lengths)],
                "n_distinct": [len(distinct)],
                "n_bytes": [len(held)],
                "held": [small(np.frombuffer(held, np.uint8))],
            }
            kinds = [pa.int64(), pa.list_(table.schema.field("id").type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 2, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one.values(), kinds)], list(one))

    kind = id_type(docs, id_col)
    columns = f"chunk bigint, ids array<{kind}>, held_out array<boolean>, counts array<bigint>, n_code bigint, code binary, taught binary, lengths binary, n_distinct bigint, n_bytes bigint, held binary"
    return rows.mapInArrow(run, columns)


def unpack(row: dict, name: str, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(row[name], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def distinct_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths = unpack(row, "lengths", row["n_distinct"], "<i4")
    return unpack(row, "held", row["n_bytes"], "u1"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def parts_of(data: np.ndarray, offsets: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by part, in their order within one; and where each part begins."""
    own = word_hashes(Words(data, offsets[:-1], offsets[1:], offsets)) % np.uint64(parts)
    return np.argsort(own, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(own.astype(np.int64), minlength=parts))])


def word_parts(packed: DataFrame, parts: int) -> DataFrame:
    """Each chunk's distinct words and their training tokens there, a row for each part that a hash deals words to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                data, offsets = distinct_words(row)
                order, edges = parts_of(data, offsets, parts)
                taught = unpack(row, "taught", row["n_distinct"], "<i4")[order]
                lengths = np.diff(offsets)[order]
                to = np.concatenate([[0], np.cumsum(lengths)])
                data = data[np.repeat(offsets[:-1][order] - to[:-1], lengths) + np.arange(len(data))]
                some = np.flatnonzero(np.diff(edges))
                cut = lambda x, at: [x[i:j].tobytes() for i, j in zip(at[some], at[some + 1])]
                columns = [np.full(len(some), row["chunk"]), some.astype(np.int32), cut(data, to[edges]), cut(lengths.astype("<i4"), edges), cut(taught, edges)]
                yield pa.RecordBatch.from_arrays([pa.array(x) if k < 2 else pa.array(x, pa.binary()) for k, x in enumerate(columns)], ["chunk", "part", "held", "lengths", "taught"])

    wanted = packed.select("chunk", "taught", "lengths", "n_distinct", "n_bytes", "held")
    return wanted.mapInArrow(run, "chunk bigint, part int, held binary, lengths binary, taught binary")


def counted_words(packed: DataFrame, parts: int) -> DataFrame:
    """Rows of two kinds: for a chunk's words of a part, ``c``, their training tokens in the corpus; and each training word once, with these as ``n``."""

    def count(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        offsets = np.concatenate([[0], np.cumsum(joined("lengths", "<i4"), dtype=np.int64)])
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined("held", "u1"))]
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()
        code = coded.indices.to_numpy()
        c = np.bincount(code, joined("taught", "<i4"), len(coded.dictionary)).astype("<i8")
        ends = np.cumsum(pc.binary_length(table["lengths"]).to_numpy() // 4)
        back = [c[x].tobytes() for x in np.split(code, ends[:-1])]
        known = pc.sort_indices(coded.dictionary).to_numpy()  # words that begin alike come together
        known = known[c[known] > 0]
        words = coded.dictionary.take(pa.array(known)).cast(pa.binary())
        pieces = [table["chunk"], table["part"], pa.array(back, pa.binary()), pa.nulls(len(back), pa.binary()), pa.nulls(len(back), pa.int64())]
        once = [pa.nulls(len(known), kind) for kind in (pa.int64(), pa.int32(), pa.binary())]
        names = ["chunk", "part", "c", "word", "n"]
        return pa.concat_tables([pa.Table.from_arrays(x, names) for x in (pieces, [*once, words, pa.array(c[known])])])

    return word_parts(packed, parts).groupBy("part").applyInArrow(count, "chunk bigint, part int, c binary, word binary, n bigint")


def flat_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(batch.column("word").to_pylist()), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def symbol_counts(trained: DataFrame) -> np.ndarray:
    """How often each byte, and the close of a word, occurs in training tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            words = Spelled.of(*flat_words(batch))
            total += np.bincount(words.symbols, np.repeat(batch.column("c").to_numpy(), np.diff(words.first)), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["symbol", "n"])

    found = trained.mapInArrow(run, "symbol int, n double").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(256)
    for row in found:
        out[row.symbol] = row.n
    return out


def table_counts(trained: DataFrame, tree: Tree, sizes: tuple[int, ...], ends: int) -> list[np.ndarray]:
    """Zeros and ones of every slot of every order (bit, slot), of all training tokens.

    A task sends its tables in pieces; those of one place are added up as they come by, in sorted partitions.
    """
    spark = trained.sparkSession
    shared = shared_value(spark, tree)
    firsts = np.concatenate([[0], np.cumsum([(1 << size) // PIECE for size in sizes])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared(), np.zeros(2 * PIECE * int(firsts[-1]))
        for batch in batches:
            words = Spelled.of(*flat_words(batch))
            kept, c = words.merged(batch.column("c").to_numpy())
            bits = Bits.of(words, own, sizes, kept)
            c = c.take(bits.symbol)
            for k in range(ORDERS):
                np.add.at(total, (bits.slots(k) + PIECE * firsts[k]) * 2 + bits.bit, c)
        for piece, values in enumerate(total.reshape(-1, 2 * PIECE)):
            if values.any():
                data = pa.compress(values.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([data])], ["piece", "data"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            largest = total.reshape(-1, 2).max(axis=1, keepdims=True)
            scaled = total.reshape(-1, 2) * np.minimum(1, LARGEST / np.maximum(largest, 1))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([scaled.T.astype("<f2").tobytes()])], ["piece", "data"])

        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist()):
                if piece != now and now is not None:
                    yield done()
                values = np.frombuffer(pa.decompress(data, 16 * PIECE, "zstd", asbytes=True))
                total = values.copy() if piece != now else total + values
                now = piece
        if now is not None:
            yield done()

    sent = trained.mapInArrow(run, "piece int, data binary")
    sums = sent.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, data binary").collect()
    out = [np.zeros((2, 1 << size), np.float16) for size in sizes]
    for row in sums:
        order = int(np.searchsorted(firsts, row.piece, "right")) - 1
        at = PIECE * (row.piece - int(firsts[order]))
        out[order][:, at : at + PIECE] = np.frombuffer(row.data, "<f2").reshape(2, PIECE)
    end = Bits.of(Spelled.of(np.zeros(0, np.uint8), np.zeros(1, np.int64), True), tree, sizes)
    for k in range(ORDERS):
        slots = end.slots(k)
        out[k][end.bit.astype(int), slots] = np.minimum(out[k][end.bit.astype(int), slots].astype(float) + ends, LARGEST)
    return out


def moments(tree: Tree, sizes: tuple[int, ...], counts: list[np.ndarray], weights: np.ndarray, words: Spelled, importance: np.ndarray) -> np.ndarray:
    """Curvature of each weight set, and in the last column its gradient, over words that count ``importance`` times."""
    kept, importance = words.merged(importance)
    bits = Bits.of(words, tree, sizes, kept)
    inputs = np.ones((len(bits.bit), ORDERS + 1), np.float32)
    for k in range(ORDERS):
        slots = bits.slots(k)
        zeros, ones = (np.maximum(counts[k][b].take(slots).astype(np.float32) - (bits.bit == b), 0) for b in (0, 1))
        inputs[:, k] = logits(zeros, ones)
    gate = gates(steps_below(zeros + ones, EXPERIENCE, too=True), words.place[kept].take(bits.symbol)).astype(np.uint8)
    order = np.argsort(gate, kind="stable")
    x, bit, weight = inputs[order], bits.bit[order], importance.take(bits.symbol)[order]
    edges = np.searchsorted(gate[order], np.arange(GATES + 1))
    out = np.zeros((GATES, ORDERS + 1, ORDERS + 2))
    for g in np.flatnonzero(np.diff(edges)):
        own = slice(edges[g], edges[g + 1])
        p = 1 / (1 + np.exp(-np.clip(x[own] @ weights[g], -MOST, MOST).astype(float)))
        error = bit[own] - p
        curve = np.maximum(p * (1 - p), np.abs(error) / 4)  # a bit taken for sure and wrongly has no curvature of its own
        out[g, :, :-1] = (x[own] * (weight[own] * curve)[:, None]).T @ x[own]
        out[g, :, -1] = (weight[own] * error) @ x[own]
    return out


def newton_steps(batch: Callable[[int, int, np.ndarray], np.ndarray], tokens: float) -> np.ndarray:
    """Weights of each set after a step on each batch, and then on all parts until a step has nothing to gain.

    ``batch`` gives the moments of the parts from one number to before another, at the weights so far, and ``tokens`` tells
    how many they are. Sets have nothing in common: one whose slope has turned goes back to where a line through its slopes is zero.
    """
    weights = np.zeros((GATES, ORDERS + 1), np.float32)
    weights[:, :ORDERS] = 1 / ORDERS
    curvature = np.tile(np.eye(ORDERS + 1), (GATES, 1, 1))
    for low, high in BATCHES:
        found = batch(low, high, weights)
        curvature += found[:, :, :-1]
        weights = weights + np.linalg.solve(curvature, found[:, :, -1:])[:, :, 0].astype(np.float32)
    step, rise = np.zeros(weights.shape), np.zeros(GATES)
    while True:
        found = batch(0, PARTS, weights)
        slope = found[:, :, -1]
        turned = (slope * step).sum(axis=1)
        back = turned < -np.maximum(rise / 4, GAIN * tokens / GATES)
        move = np.linalg.solve(found[:, :, :-1] + np.eye(ORDERS + 1), slope[:, :, None])[:, :, 0]
        gain = (slope * move).sum() / 2
        share = np.where(back, turned / np.where(back, rise - turned, 1), 0)
        rise = np.where(back, rise * (1 + share), (slope * move).sum(axis=1))
        move = np.where(back[:, None], step * share[:, None], move)
        step = np.where(back[:, None], step + move, move)
        weights = (weights + move).astype(np.float32)
        if gain <= GAIN * tokens and not back.any():
            return weights


def learn_weights(tree: Tree, sizes: tuple[int, ...], counts: list[np.ndarray], words: list[bytes], importance: np.ndarray) -> np.ndarray:
    """Weights of each set from words at hand, every one of which is in each batch."""
    spelled = Spelled.of(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]))
    return newton_steps(lambda low, high, weights: moments(tree, sizes, counts, weights, spelled, importance), float(importance.sum()))


def batch_moments(trained: DataFrame, shared: Callable[[], tuple], weights: np.ndarray, low: int, high: int) -> np.ndarray:
    """Moments of all training words of the parts from ``low`` to before ``high``; ``shared`` gives tree, sizes and counts."""
    part = F.pmod(F.xxhash64(F.lit(2), "word"), F.lit(PARTS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = None, np.zeros((GATES, ORDERS + 1, ORDERS + 2))
        for batch in batches:
            known = known or shared()
            total += moments(*known, weights, Spelled.of(*flat_words(batch)), batch.column("c").to_numpy().astype(float))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total.ravel()[place])], ["place", "x"])

    sums = trained.where((part >= low) & (part < high)).mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    out = np.zeros(GATES * (ORDERS + 1) * (ORDERS + 2))
    for row in sums.collect():
        out[row.place] = row.x
    return out.reshape(GATES, ORDERS + 1, ORDERS + 2)


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    sizes: tuple[int, ...] = (12, 16, 18, 20, 22),
    chunk: int = CHUNK * 3 // 4,
) -> DataFrame:
    """Score every row; learn from those that are not ``held_out``.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training rows have), ``train_tokens``,
    ``base_score`` (smoothed log10 probability of the tokens one by one), ``score`` (the mix's log10 probability of
    the text) and ``bits_per_byte`` (its bits over the bytes of the text's words, closes and end). Counts and weights are
    learned from all training rows. ``sizes`` are the bits of the slot numbers of each order's table, 12 at least.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_kind = to_arrow_type(docs.schema[id_col].dataType)
    held, teaches = F.coalesce(held_out, F.lit(False)), F.coalesce(~held_out, F.lit(False))
    packed = settle(packed_documents(docs, held, teaches, id_col, text_col, chunk), "lm-documents")
    words = packed.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-words // TOGETHER))
    known = settle(counted_words(packed, parts), "lm-words")
    trained = known.where("word is not null").select("word", F.col("n").alias("c"))
    ends = docs.where(teaches).count()
    n, distinct = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, distinct = n + ends, distinct + (ends > 0)

    symbols = symbol_counts(trained)
    symbols[END] += ends
    tree = Tree.of(symbols)
    counts = table_counts(trained, tree, sizes, ends)
    tables = shared_value(spark, (tree, sizes, counts))
    ending = Spelled.of(np.zeros(0, np.uint8), np.zeros(1, np.int64), True)

    def batch(low: int, high: int, weights: np.ndarray) -> np.ndarray:
        found = batch_moments(trained, tables, weights, low, high)
        return found if low else found + moments(tree, sizes, counts, weights, ending, np.array([ends], float))

    weights = newton_steps(batch, n)
    shared = shared_value(spark, Model(tree, sizes, counts, weights))

    held_model: list[Mixed] = []  # one a task

    def run(documents: pa.Table, listed: pa.Table) -> pa.Table:
        if not held_model:
            held_model.append(Mixed(shared()))
        return pa.concat_tables([scored(row, listed, held_model[0]) for row in documents.to_pylist()])

    def scored(row: dict, listed: pa.Table, mixed: Mixed) -> pa.Table:
        data, offsets = distinct_words(row)
        c = np.zeros(row["n_distinct"] + 1, np.int64)
        c[parts_of(data, offsets, parts)[0]] = np.frombuffer(b"".join(listed.sort_by("part")["c"].to_pylist()), "<i8")
        c[-1] = ends
        counts = np.array(row["counts"], np.int64) + 1
        words = np.full(int(counts.sum()), row["n_distinct"], np.int64)
        last = np.cumsum(counts) - 1
        inside = np.ones(len(words), bool)
        inside[last] = False
        words[inside] = unpack(row, "code", row["n_code"], "<i4")
        size = np.append(np.diff(offsets) + 1, 1)
        own = np.log10((c + 0.1) / (n + 0.1 * (distinct + 1)))
        begins = np.concatenate([[0], last[:-1] + 1])
        base, seen, spelled = (np.add.reduceat(x[words], begins) for x in (own, (c > 0).astype(np.int64), size))
        nats = refine(mixed.of(data, offsets, True), words, counts)
        return pa.Table.from_arrays(
            [
                pa.array(row["ids"], id_kind),
                pa.array(row["held_out"], pa.bool_()),
                pa.array(counts),
                pa.array(seen),
                pa.array(np.full(len(counts), n)),
                pa.array(base),
                pa.array(-nats / LN10),
                pa.array(nats / LN2 / spelled),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    kinds = f"id {id_type(docs, id_col)}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    packs, words = packed.drop("taught").groupBy("chunk"), known.where("chunk is not null").select("chunk", "part", "c").groupBy("chunk")
    return packs.cogroup(words).applyInArrow(run, kinds).withColumnRenamed("id", id_col)
