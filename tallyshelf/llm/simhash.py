"""Near-duplicate documents by SimHash, linked through a Gray-order hierarchical index.

A fingerprint holds, for each of 64 bits, what the majority of the XXH64 hashes (seed 42) of a
text's word shingles holds. Equal fingerprints are folded to one row first, so groups of copies
cost one row. Two fingerprints at most ``distance`` bits apart agree on at least
``blocks - distance`` of ``blocks`` bit blocks, so each is sent to the tasks of all combinations of
that many blocks: the shared masked bit patterns that form the top nodes of the index. Below a top
node, codes are sorted by Gray rank; neighbours share most bits, and runs of them become nodes
that keep the mask and the pattern of the bits all their codes share. Pairs of nodes are walked
from the top: differences in shared bits add up, pairs of nodes beyond the distance are dropped
as a whole, and pairs that cannot exceed it are linked as a whole. Each task sends on links from
its codes to the first code of their local component, never all pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like
any other. A repeated row gets its row again. A null id never is a component id unless no
document of the component has an id. Other columns are not looked at.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import id_type, row_keys, small_batches
from ._text import SPACED, Words, chunks, find_words, join_words
from .components import components
from .xxh64 import xxh64

SEED = 42
#: The bits of each byte value, as float so that products are exact and fast.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Codes of a leaf, and children of a node.
FAN = 16
#: Rows a task gathers before it looks at the groups that are complete.
GATHER = 400_000
#: Pairs of nodes looked at in one step.
STEP = 20_000


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, text by text, and each text's number of them.

    Repeats are included; a text of fewer words is one shingle, one without words has none.
    """
    joined, begins, _ = join_words(words)
    lengths, first = words.ends - words.starts, words.first
    counts = words.counts()
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    one = np.repeat(first[:-1], made) + np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    last = np.minimum(one + size, np.repeat(first[1:], made)) - 1
    return xxh64(joined, begins[one], begins[last] + lengths[last], SEED), made


def majority_bits(hashes: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints: the bits set in over half of a text's hashes; text by text, ``made`` of each."""
    ends = np.cumsum(made).tolist()
    lanes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + 256 * np.arange(8)
    ones = np.zeros((len(made), 64), np.int64)
    for k, (n, end) in enumerate(zip(made.tolist(), ends)):
        if n:  # each byte's values are counted, then each value's bits
            counts = np.bincount(lanes[end - n : end].ravel(), minlength=2048).reshape(8, 256)
            ones[k] = (counts @ BITS).ravel()
    return ((ones * 2 > made[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def fingerprints(words: Words, size: int) -> np.ndarray:
    """Fingerprints of all shingles of each text, repeats included."""
    return majority_bits(*shingle_hashes(words, size))


def masks(blocks: int, distance: int, bits: int = 64) -> list[int]:
    """Masks of all combinations of blocks two codes within the distance must share one of."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - distance)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Links:
    """Union of nodes 0..n-1 by arrays; a node points at a node no larger than itself."""

    def __init__(self, n: int):
        self.to = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.to[i], self.to[j]
            apart = i != j
            i, j = np.minimum(i, j)[apart], np.maximum(i, j)[apart]
            np.minimum.at(self.to, j, i)
            while (shorter := self.to[self.to]).tobytes() != self.to.tobytes():
                self.to = shorter


class GrayIndex:
    """Nodes over codes in Gray order; each keeps the mask and pattern of the bits its codes share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        every, some = codes, codes
        self.levels = []  # from leaves up: first code, end, shared mask, pattern
        starts = np.arange(0, len(codes), FAN)
        span = FAN
        while True:
            every, some = np.bitwise_and.reduceat(every, starts), np.bitwise_or.reduceat(some, starts)
            shared = ~(every ^ some)
            first = np.arange(len(starts)) * span
            self.levels.append((first, np.minimum(first + span, len(codes)), shared, every & shared))
            if len(starts) == 1:
                break
            starts, span = np.arange(0, len(every), FAN), span * FAN

    def link(self, distance: int, links: Links, base: int) -> None:
        """Link all codes within the distance; code k is node base + k."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > STEP:
                todo += [(level, a[k : k + STEP], b[k : k + STEP]) for k in range(0, len(a), STEP)]
                continue
            if level < 0:
                near = np.bitwise_count(self.codes[a] ^ self.codes[b]) <= distance
                links.add(base + a[near], base + b[near])
                continue
            first, end, shared, pattern = self.levels[level]
            both = shared[a] & shared[b]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.int64)
            most = apart + np.bitwise_count(~both)
            whole = most <= distance
            for x, y in zip(a[whole].tolist(), b[whole].tolist()):
                own = base + np.r_[first[x] : end[x], first[y] : end[y]]
                links.add(own[1:], np.full(len(own) - 1, own[0]))
            on = (apart <= distance) & ~whole
            a, b = a[on], b[on]
            if not len(a):
                continue
            below = len(self.codes) if level == 0 else len(self.levels[level - 1][0])
            i = (a[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            j = (b[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            own = np.repeat(a == b, FAN * FAN)
            good = (i < below) & (j < below) & (~own | (i < j if level == 0 else i <= j))
            todo.append((level - 1, i[good], j[good]))


def link_groups(group: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, first code of its local component) inside groups; ``group`` is sorted."""
    number = np.zeros(len(group), np.int64)
    number[1:] = np.cumsum(group[1:] != group[:-1])
    order = np.lexsort((gray_rank(codes), number))
    codes, number = codes[order], number[order]
    sizes = np.bincount(number)
    left = sizes[number]  # codes in the group
    links = Links(len(codes))
    small = left <= FAN
    for shift in range(1, FAN):
        i = np.flatnonzero(small[:-shift] & (number[:-shift] == number[shift:])) if shift < len(codes) else []
        if not len(i):
            break
        near = np.bitwise_count(codes[i] ^ codes[i + shift]) <= distance
        links.add(i[near], i[near] + shift)
    begins = np.cumsum(sizes) - sizes
    for g in np.flatnonzero(sizes > FAN):
        GrayIndex(codes[begins[g] : begins[g] + sizes[g]]).link(distance, links, begins[g])
    moved = np.flatnonzero(links.to != np.arange(len(codes)))
    return codes[moved], codes[links.to[moved]]


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, words: int, *keep) -> DataFrame:
    """``id``, ``fp`` and the columns of ``keep`` for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text"):
            found = fingerprints(find_words(table["text"], SPACED, lower=True), words)
            done = table.drop_columns("text").append_column("fp", pa.array(found))
            yield from done.to_batches()

    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


def near_links(codes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all codes of column ``fp`` (distinct) within the distance."""
    top = masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in top]
    nodes = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])
    sent = codes.select("fp", F.inline(nodes)).repartition("m", "v").sortWithinPartitions("m", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def linked(table: pa.Table) -> pa.RecordBatch:
            value, m = (table[c].to_numpy() for c in ("v", "m"))
            group = np.zeros(len(m), np.int64)
            group[1:] = np.cumsum((m[1:] != m[:-1]) | (value[1:] != value[:-1]))
            a, b = link_groups(group, table["fp"].to_numpy().view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= GATHER:
                table = pa.Table.from_batches(held)
                value, m = (table[c].to_numpy() for c in ("v", "m"))
                ends = np.flatnonzero((m[1:] != m[:-1]) | (value[1:] != value[:-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0
                if cut:
                    yield linked(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = 0  # of what is new; a group longer than that is gathered on
        if held:
            yield linked(pa.Table.from_batches(held))

    return sent.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    distance: int = 4,
    blocks: int = 6,
    keep: tuple = (),
) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (bigint), ``root`` (the component's first
    fingerprint) and ``component_id`` (its smallest id). ``keep`` adds columns, by expression.

    Texts are read once; fingerprints and links are written to the shared folder.
    """
    kind = id_type(docs, id_col)
    rows = settle(fingerprint_table(docs, id_col, text_col, words, *keep), "fingerprints")
    codes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(codes.select("fp"), distance, blocks), "simhash")
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = settle(rooted.drop("least").join(named, "root"), "simhash-codes")
    out = rows.join(by_code, "fp").withColumn("component_id", F.col("component_id").cast(kind))
    others = [c for c in rows.columns if c not in ("id", "fp")]
    return out.select(F.col("id").alias(id_col), "fp", "root", "component_id", *others)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """One row of ``docs`` for each component that ``near`` finds: the one with the smallest id, rows without an id last.

    Of rows with one id and text the first in order of the other columns stays. Only keys are
    compared to find it; the documents are shuffled once, to be joined with the keys that stay.
    """
    keys = row_keys(F.col(id_col), F.col(text_col))
    found = near(docs, id_col, text_col, keep=tuple(keys), **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, "k1", "k2")).alias("first"))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(*keys, F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0), *others).alias("others"))
    kept = rows.join(first.select("first.k1", "first.k2"), ["k1", "k2"])
    kept = kept.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.min("others").alias("others"))
    each = {c: F.col("others")[c] for c in others} | {id_col: F.col("id"), text_col: F.col("text")}
    return kept.select(*[each[c].alias(c) for c in docs.columns])


def hex_digits(code: str) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))
