"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a limit.

Equal sets are folded to one row first, so groups of copies cost one row. Every set has a SimHash fingerprint:
the majority bits of its shingles' hashes. Sets whose fingerprints differ in few bits, found by the masked patterns and
the Gray-order index of ``simhash``, are compared exactly and linked first. Copies at the limit itself differ in about ten of
64 bits, beyond what such an index can find, so bands complete these links. Candidates there are sets of different components that
share a band: the least values of ``ROWS`` hash orders of their shingles. Two sets of similarity j
share none of ``BANDS`` bands with probability (1 - j**ROWS) ** BANDS, which is 3e-5 at 0.8 and less
above it. A join on bands lets a pair through only if of all ``ROWS * BANDS`` least values, of which each set
keeps one byte, as many are equal as at that limit all but ``MISSED`` of the pairs have; that sees most pairs of
moderate similarity off before they become rows. The similarity of what is left is computed exactly from both
sets by a join, so no pair below the limit is linked.

A large group of near copies shares its bands, and its pairs are not all looked at: the set that
meets most others becomes the pivot of a band, is compared with all of the band and leaves it, and
components are taken. Sets that are in one component need no comparison. That goes on while it
halves the pairs. Then pairs of sets that share a band and are in different components are left, and only those that may be
similar become rows to be compared, each in the first band it shares. Of sets of fewer than ``SMALL`` shingles a byte of each of
``WIDE`` bins of shingles tells: where two differ, so do the sets, so no pair of the limit is lost, and few below it are left.
Of larger sets ``WIDE`` least values tell pairs of about 0.7 from those of 0.8.

Defined results: texts of fewer words than a shingle are one shingle; null and empty texts, and those
without words, have the empty set and are equal. A repeated row gets its row again.
"""

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import join_anew, row_keys, small_batches, trimmed
from ._text import GOLDEN, SPACED, chunks, find_words, mix
from .components import components
from .simhash import majority_bits, near_links, shingle_hashes

ROWS, BANDS = 4, 20
#: Bits in which fingerprints of sets that are compared first may differ, and the blocks of their patterns.
DISTANCE, BLOCKS = 4, 6
#: Bytes of text worked on at a time: arrays over shingles are many times as large, and stay with the worker.
SOME = 2 << 20
#: Share of pairs at the limit that the bytes of the least values may see off.
MISSED = 1e-5
#: Factors and offsets of the hash orders.
ORDERS = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * GOLDEN).reshape(2, -1)
#: Bytes that tell similar sets from moderately similar ones where all pairs are left, and the orders of least values.
WIDE = 400
WIDER = mix(np.arange(1000, 1000 + 2 * WIDE, dtype=np.uint64) * GOLDEN).reshape(2, -1)
#: Size from which sets differ in too many bins for these to tell.
SMALL = 1000
#: Pairs left for each row of a shared band at which no pivot is taken any more.
FEW = 2


def shingle_sets(column: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, in order, text by text; and each text's number of them."""
    hashes, made = shingle_hashes(find_words(column, SPACED, lower=True), words)
    text = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(made))


def least_equal(similarity: float, values: int = ROWS * BANDS) -> int:
    """How many of the least values are equal in all but ``MISSED`` of the pairs of that similarity."""
    below = 0.0
    for k in range(values + 1):
        below += comb(values, k) * similarity**k * (1 - similarity) ** (values - k)
        if below > MISSED:
            return k
    return values


def unequal_bytes(x: Column, y: Column) -> Column:
    x = x.bitwiseXOR(y)
    for step in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def equal_bytes(a: str, b: str, values: int = ROWS * BANDS) -> Column:
    """How many of so many bytes of two arrays of 64-bit numbers are equal."""
    if values > ROWS * BANDS:  # as one expression per number the code would be too long to compile
        return F.lit(values) - F.aggregate(F.zip_with(a, b, unequal_bytes), F.lit(0), lambda total, n: total + n)
    return F.lit(values) - reduce(Column.__add__, (unequal_bytes(F.col(a)[k], F.col(b)[k]) for k in range(values // 8)))


def first_shared(a: str, b: str, place: str) -> Column:
    """Whether no band before that place is shared, by the bytes of the bands' least values."""
    shared = []
    for k in range(BANDS):
        word = F.shiftright(F.col(a)[k // 2].bitwiseXOR(F.col(b)[k // 2]), 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        shared.append((word == 0) & (F.col(place) > k))
    return ~reduce(Column.__or__, shared)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, the bands of each set, and a byte of each least value (none of an empty one)."""
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    name = np.zeros((len(sizes), 2), "<u8")
    bands = np.zeros((len(sizes), BANDS), np.uint64)
    sketch = np.zeros((len(sizes), ROWS * BANDS), np.uint8)
    if len(some):
        for k in range(2):
            name[some, k] = mix(np.add.reduceat(mix(hashes + ORDERS[1, k]), starts) + sizes[some].astype(np.uint64))
        for band in range(BANDS):
            value = np.full(len(some), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                least = np.minimum.reduceat((hashes ^ ORDERS[1, k]) * (ORDERS[0, k] | np.uint64(1)), starts)
                value = mix((value ^ least) * GOLDEN + np.uint64(1))
                sketch[some, k] = mix(least)
            bands[some, band] = value
    return [x.tobytes() for x in name], bands.view(np.int64), sketch.view(np.int64)


def signature_table(docs: DataFrame, id_col: str, text_col: str, words: int, *keep) -> DataFrame:
    """``id``, the columns of ``keep``, ``s`` (the set), ``n`` (its size), ``fp`` (its SimHash), ``bands`` and ``sketch`` for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", SOME):
            hashes, sizes = shingle_sets(table["text"], words)
            names, *both = signatures(hashes, sizes)
            done = table.drop_columns("text").append_column("s", pa.array(names, pa.binary())).append_column("n", pa.array(sizes))
            done = done.append_column("fp", pa.array(majority_bits(hashes, sizes)))
            for name, values in zip(("bands", "sketch"), both):
                listed = [own if n else [] for own, n in zip(values.tolist(), sizes.tolist())]
                done = done.append_column(name, pa.array(listed, pa.list_(pa.int64())))
            yield from done.to_batches()

    kinds = [f"{name} {kind}" for name, kind in rows.dtypes if name != "text"]
    return rows.mapInArrow(trimmed(run), ", ".join([*kinds, "s binary, n bigint, fp bigint, bands array<bigint>, sketch array<bigint>"]))


def bin_bytes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A byte of each of ``WIDE`` bins that the shingles of each set are dealt to: no more of them differ than shingles do."""
    values = mix(hashes)
    place = np.repeat(np.arange(len(sizes)), sizes) * WIDE + (values >> np.uint64(32)).astype(np.int64) % WIDE
    total = np.bincount(place, (values & np.uint64(0xFF)).astype(np.float64), len(sizes) * WIDE)
    return (total.astype(np.int64) % 256).astype(np.uint8).reshape(-1, WIDE)


def least_bytes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A byte of each of ``WIDE`` least values of each set; no set is empty."""
    starts = np.cumsum(sizes) - sizes
    wide = np.zeros((len(sizes), WIDE), np.uint8)
    for k in range(WIDE if len(sizes) else 0):
        wide[:, k] = mix(np.minimum.reduceat((hashes ^ WIDER[1, k]) * (WIDER[0, k] | np.uint64(1)), starts))
    return wide


def wide_sketches(sets: DataFrame, similarity: float) -> DataFrame:
    """``s``, ``bins`` and ``wide`` of sets with their shingles: bins if they are small, least values if a similar one may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            hashes = lists.flatten().to_numpy().view(np.uint64)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            made = [batch.column("s")]
            for make, of in ((bin_bytes, sizes < SMALL), (least_bytes, sizes >= similarity * SMALL - 1)):
                found = iter(make(hashes[np.repeat(of, sizes)], sizes[of]).view(np.int64).tolist())
                made.append(pa.array([next(found) if own else [] for own in of.tolist()], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(made, ["s", "bins", "wide"])

    return sets.where(F.size("shingles") > 0).mapInArrow(trimmed(run), "s binary, bins array<bigint>, wide array<bigint>")


def may_be_similar(similarity: float) -> Column:
    """Whether sets ``s`` and ``p`` of ``n`` and ``m`` shingles may be that similar, by their bins or least values."""
    differ = F.lit(WIDE) - equal_bytes("bins", "of_bins", WIDE)
    few = differ <= (F.col("n") + F.col("m")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return F.when(F.greatest("n", "m") < SMALL, few).otherwise(equal_bytes("wide", "of_wide", WIDE) >= least_equal(similarity, WIDE))


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """``s`` and ``shingles`` of the sets of ``wanted``, each given with the keys of one row that has it."""
    rows = docs.select(*row_keys(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, "text", SOME):
            hashes, sizes = shingle_sets(table["text"], words)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
            yield from table.drop_columns("text").append_column("shingles", listed).to_batches()

    return rows.join(wanted, ["k1", "k2"]).select("s", "text").mapInArrow(trimmed(run), "s binary, shingles array<bigint>").dropDuplicates(["s"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets have at least that similarity."""
    one, other = (sets.select(F.col("s").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    every = F.size("of_a") + F.size("of_b") - both
    return pairs.join(other, "b").join(one, "a").where(both / every >= similarity).select("a", "b")


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that connect the sets whose fingerprints ``fp`` are equal or within ``DISTANCE`` by a chain."""
    codes = settle(sets.groupBy("fp").agg(F.min("s").alias("first")), "near-codes")
    equal = sets.select("s", "fp").join(codes, "fp").where("s <> first").select(F.col("first").alias("a"), F.col("s").alias("b"))
    one, other = (codes.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in "ab")
    near = near_links(codes.select("fp"), DISTANCE, BLOCKS).join(one, "a").join(other, "b").select("of_a", "of_b")
    return equal.union(near)


def set_links(sets: DataFrame, contents, similarity: float) -> DataFrame:
    """Components' links ``node``, ``root`` of the sets ``s``, ``n``, ``fp``, ``bands``, ``sketch`` that are similar, by a chain of pairs.

    ``contents`` makes the table of the shingles of the sets it is given.
    """
    alike = settle(simhash_pairs(sets), "near-alike")
    entries = settle(sets.select("s", "n", F.posexplode("bands").alias("place", "band")), "near-bands")
    sizes = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = settle(join_anew(entries, sizes, "band"), "near-shared")
    central = shared.groupBy("s").agg(F.sum("size").alias("central"))
    wanted = reduce(DataFrame.union, (alike.select(F.col(c).alias("s")) for c in "ab"), central.select("s")).distinct()
    shingles = settle(contents(wanted), "near-shingles")
    open_ = settle(shared.drop("size").join(central.join(sets.select("s", "sketch"), "s"), "s"), "near-open")
    roots = components(similar(alike, shingles, similarity), "near-links")
    close = (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6) & (F.col("root") != F.col("to"))
    close &= equal_bytes("sketch", "of_p") >= least_equal(similarity)
    left = None
    while True:
        rooted = open_.join(roots, open_["s"] == roots["node"], "left").select("band", "place", "s", "n", "central", "sketch", F.coalesce("root", "s").alias("root"))
        by_root = rooted.groupBy("band", "root").agg(F.count("*").alias("size"))
        by_band = by_root.groupBy("band").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main"))
        mixed = by_band.where("main.size < size").select("band", "size", F.col("main.root").alias("most"), (F.col("size") - F.col("main.size")).alias("few"))
        open_ = settle(join_anew(rooted, mixed, "band"), "near-open")
        bands = open_.groupBy("band").agg(F.max("size").alias("size"), F.max("few").alias("few"))
        pairs, rows = bands.agg(F.sum(F.col("size") * F.col("few")), F.sum("size")).first()
        if not rows:
            return roots
        last = pairs <= FEW * rows or (left is not None and pairs > 0.5 * left)
        left, near, served = pairs, close, open_
        if last:
            wide = wide_sketches(shingles.join(open_.select("s").distinct(), "s", "left_semi"), similarity)
            served = open_.join(wide, "s")
            near &= first_shared("sketch", "of_p", "place") & may_be_similar(similarity)
            near &= (F.col("p") < F.col("s")) | (F.col("root") == F.col("most"))  # not once from either side
            named = {"s": "p", "n": "m", "root": "to", "sketch": "of_p", "bins": "of_bins", "wide": "of_wide"}
            one = served.where("root <> most").select("band", *(F.col(c).alias(name) for c, name in named.items()))
        else:
            first = served.groupBy("band").agg(F.max(F.struct("central", "s", "n", "root", "sketch")).alias("first"))
            named = {"s": "p", "n": "m", "root": "to", "sketch": "of_p"}
            one = first.select("band", *(F.col(f"first.{c}").alias(name) for c, name in named.items()))
        met = served.join(one.hint("rebalance"), "band").where(near)
        tried = met.select(F.least("p", "s").alias("a"), F.greatest("p", "s").alias("b")).distinct()
        found = similar(tried, shingles, similarity)
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        next_roots = components(found.union(known), "near-links")
        if last:
            return next_roots
        kept = open_.join(one.select("band", F.col("p").alias("s")).hint("rebalance"), ["band", "s"], "left_anti")
        open_, roots = kept.select("band", "place", "s", "n", "central", "sketch"), next_roots


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    keep: tuple = (),
) -> DataFrame:
    """One row per document: ``id_col``, ``root`` (a set of its component), and the columns of ``keep``."""
    small_batches(docs.sparkSession)
    keys = row_keys(F.col(id_col), F.col(text_col))
    named = [F.struct(*keys).alias("row"), *([F.struct(*keep).alias("others")] if keep else [])]
    rows = settle(signature_table(docs, id_col, text_col, words, *named), "signatures")
    sets = rows.groupBy("s").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))

    def contents(wanted: DataFrame) -> DataFrame:
        one = sets.select("s", "row.k1", "row.k2").join(wanted, "s")
        return set_table(docs, id_col, text_col, words, one)

    roots = set_links(sets.select("s", "n", "fp", "bands", "sketch"), contents, similarity)
    out = rows.drop("n", "fp", "bands", "sketch").join(roots, rows["s"] == roots["node"], "left")
    others = ["others.*"] if keep else []
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "s").alias("root"), *others)
