"""Approximate nearest neighbours by cosine, with a hierarchical k-means tree.

The tree is fitted on the driver on a sample of at most about ``sample_rows`` vectors, chosen by a
hash, which bounds it; every row is then put into the leaf it descends to. A query walks the tree
best bin first: a priority queue holds the nodes seen, the one with the nearest centre is opened
next, and leaves are visited in the order they come out. How many leaves is calibrated: for a
bounded number of sample vectors the true neighbours are found among all rows, and visits are
widened until the leaves visited hold at least ``recall`` of them.

Rows travel as blocks of a leaf. Leaves are dealt to groups, a leaf with many rows to several, by the rows counted in
it. A block of queries travels once to each group, not to each leaf, with the leaves that each query visits as bits.
A task takes a group: its queries meet the leaves they visit there. Products over unit vectors make a short list with
some slack, less as better neighbours are known; its scores are computed anew, pair by pair, on the original vectors
in double precision, so equal vectors have equal scores.

Defined results: vectors that are null or zero, or hold null, NaN or infinity, take no part. Only
vectors of one length are compared; a length of which the sample has none gets a single leaf. A row
without an id is a candidate, after all others in ties, and never a query. A query is not compared
with rows of its own id. Rows that repeat a query's id and vector make one query. Repeated
candidates each count. Other columns are not looked at; an empty table is fine.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import give_back, partitions, shared_value, small_batches, trimmed
from ._vectors import NO_ID, Block, TopLists, best_of_tile, hash_of, id_numbers, ids_array, usable

#: Vectors of a block, queries of a block, and queries that meet a group at a time.
ROWS, QUERIES, TOGETHER = 1024, 256, 65_536
#: Bytes of vectors a task holds before it packs them by leaf, and bytes of blocks it then sends at a time.
HELD, SENT = 32 << 20, 4 << 20
#: Rows of a leaf that one group takes.
DEALT = 16 * ROWS
#: Bytes of vectors a group has at most, about.
MOST = 32 << 20
#: Products differ from exact scores by less than this.
SLACK = 1e-9
LEAVES = "dim int, leaf int, ids binary, vectors binary"
ASKED = "dim int, ids binary, vectors binary, seen binary"
EMPTY = pa.table({"query_id": pa.array([], pa.int64()), "query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, whatever stands in other rows.

    Rows are first brought near one by a power of two, which changes no digit and keeps squares finite.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres of unit length and each vector's; centres without a vector go."""
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < k:
        far = np.clip(1 - (vectors @ centres.T).max(axis=1), 0, None)
        if far.sum() < 1e-9:
            break
        centres = np.vstack([centres, vectors[np.searchsorted(np.cumsum(far), rng.random() * far.sum())]])
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        sums = sums[(np.bincount(own, minlength=len(centres)) > 0) & (np.abs(sums).max(axis=1) > 1e-12)]
        centres = unit(sums) if len(sums) else centres
    return centres, (vectors @ centres.T).argmax(axis=1)


class Tree:
    """Nodes by number, the root first: centre, children (none for a leaf) and leaf number."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_size: float, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.centres = [sample[:1].sum(axis=0)]
        self.children: list[list[int]] = [[]]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop(0)
            if len(rows) <= max(leaf_size, 2 * branch):
                continue
            centres, own = k_means(sample[rows], branch, rng)
            if len(centres) < 2 or np.bincount(own, minlength=len(centres)).max() == len(rows):
                continue
            for c, centre in enumerate(centres):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), rows[own == c]))
                self.centres.append(centre)
                self.children.append([])
        self.centres = np.array(self.centres)
        leaves = [n for n, c in enumerate(self.children) if not c]
        self.leaf = {n: k for k, n in enumerate(leaves)}

    def descend(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            children = self.children[node]
            own = (vectors[rows] @ self.centres[children].T).argmax(axis=1)
            todo += [(child, part) for c, child in enumerate(children) if len(part := rows[own == c])]
        return out

    def visits(self, vector: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        near = -(self.centres @ vector)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (near[child], child))
            else:
                out.append(self.leaf[node])
        return out


def _pack(trees: dict[int, Tree]):
    """Packs (id, vector) batches into blocks by leaf, whenever some megabytes are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for dim, parts in held.items():
                ids, leaf, vectors = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((ids, leaf))
                cuts = np.flatnonzero(np.diff(leaf[order])) + 1
                some = [part[at : at + ROWS] for part in np.split(order, cuts) if len(part) for at in range(0, len(part), ROWS)]
                many = max(1, SENT // (8 * (dim + 1) * max(map(len, some), default=1)))
                for at in range(0, len(some), many):
                    now = some[at : at + many]
                    packed = [[dim] * len(now), [int(leaf[x[0]]) for x in now], [ids[x].astype("<i8").tobytes() for x in now], [vectors[x].astype("<f8").tobytes() for x in now]]
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(packed, kinds)], ["dim", "leaf", "ids", "vectors"])
            held.clear()

        for batch in batches:
            ids = id_numbers(batch)
            for dim, own, vectors in usable(batch, zeros=False):
                leaf = trees[dim].descend(unit(vectors)) if dim in trees else np.zeros(len(vectors), np.int64)
                held.setdefault(dim, []).append((ids[own], leaf, vectors))
                size += vectors.nbytes + 16 * len(own)
            if size >= HELD:
                yield from blocks()
                size = 0
        yield from blocks()

    return run


def _ask(trees: dict[int, Tree], most: dict[int, int]):
    """Packs (id, vector) batches of queries into blocks with the leaves each visits, a bit for every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = id_numbers(batch)
            for dim, own, vectors in usable(batch, zeros=False):
                for at in range(0, len(vectors), QUERIES):
                    some = vectors[at : at + QUERIES]
                    seen = np.zeros((len(some), len(trees[dim].leaf) if dim in trees else 1), bool)
                    for row, vector in enumerate(unit(some)):
                        seen[row, trees[dim].visits(vector, most[dim]) if dim in trees else 0] = True
                    packed = [dim, ids[own[at : at + QUERIES]].astype("<i8").tobytes(), some.astype("<f8").tobytes(), np.packbits(seen, axis=1).tobytes()]
                    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(packed, kinds)], ["dim", "ids", "vectors", "seen"])

    return run


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The bytes of all rows of a binary column, one after another."""
    parts = []
    for chunk in table[name].chunks:
        _, offsets, data = chunk.buffers()
        if len(chunk) and data:
            first, last = np.frombuffer(offsets, np.int32)[[chunk.offset, chunk.offset + len(chunk)]]
            parts.append(np.frombuffer(data, np.uint8)[first:last])
    return (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint8), *parts])).view(kind)


def having(table: pa.Table, name: str, value: int) -> pa.Table:
    """Rows with a value; not copied if all rows have it."""
    good = pc.equal(table[name], value)
    return table if pc.all(good).as_py() else table.filter(good)


def search(asked: pa.Table, listed: pa.Table, k: int) -> Iterator[pa.Table]:
    """The ``k`` best of a group's blocks for each query, by dimension."""
    for dim in pc.unique(listed["dim"]).to_pylist():
        queries, blocks = having(asked, "dim", dim), having(listed, "dim", dim)
        names = joined(queries, "ids", "<i8")
        if not len(names):
            continue
        vectors = joined(queries, "vectors", "<f8").reshape(len(names), dim)
        seen = joined(queries, "seen", "u1").reshape(len(names), -1)
        near, best, cuts, least = unit(vectors), TopLists(k, float), 0, np.full(len(names), -np.inf)
        for leaf in pc.unique(blocks["leaf"]).to_pylist():
            rows = having(blocks, "leaf", leaf)
            own = Block(joined(rows, "ids", "<i8"), joined(rows, "vectors", "<f8").reshape(-1, dim))
            visiting = np.flatnonzero(seen[:, leaf >> 3] >> (7 - (leaf & 7)) & 1)
            for begin in range(0, len(own.ids), ROWS):
                ids, there = own.ids[begin : begin + ROWS], own.vectors[begin : begin + ROWS]
                other = unit(there).T
                for at in range(0, len(visiting), QUERIES):
                    some = visiting[at : at + QUERIES]
                    scores, allowed = near[some] @ other, names[some][:, None] != ids
                    if np.isfinite(least[some]).all():
                        i, j = np.nonzero((scores >= least[some][:, None] - SLACK) & allowed)
                    else:
                        i, j = best_of_tile(scores, allowed, k, SLACK)
                    best.add(some[i], ids[j], cosine(vectors[some[i]], there[j]))
                    if best.cuts != cuts:
                        cuts, least = best.cuts, best.least(len(names))
        query, found, scores = best.best()
        keys = np.array([hash_of(v.tobytes()) for v in vectors], np.int64)
        columns = [pa.array(names[query]), pa.array(keys[query]), ids_array(found), pa.array(scores)]
        yield pa.Table.from_arrays(columns, ["query_id", "query", "vec_id", "score"])


class Index:
    """Trees by dimension, leaves to visit, and the rows of all leaves in the shared folder."""

    def __init__(self, trees: dict[int, Tree], blocks: DataFrame, visits: dict[int, int]):
        self.trees, self.blocks, self.visits = trees, blocks, visits


def build(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    recall: float = 0.97,
    sample_rows: int = 20_000,
    calibration_queries: int = 200,
    leaf_rows: int = 512,
    branch: int = 8,
) -> Index:
    """Fit trees on a sample of at most about ``sample_rows``, index every row, calibrate visits."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    n = rows.count()
    share = min(1.0, sample_rows / n) if n else 1.0
    chosen = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1_000_000)) < share * 1_000_000)
    sample: dict[int, list] = {}
    for batch in chosen.toArrow().to_batches():
        for dim, own, found in usable(batch, zeros=False):
            if dim:
                sample.setdefault(dim, []).append((id_numbers(batch)[own], found))
    trees, queries = {}, {}
    for dim, parts in sample.items():
        ids, found = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((*found.T, ids))  # whatever the order rows arrive in
        ids, found = ids[order], found[order]
        trees[dim] = Tree(unit(found), branch, leaf_rows * share)
        step = max(1, len(ids) // calibration_queries)
        queries[dim] = (ids[::step][:calibration_queries], found[::step][:calibration_queries])
    shared = shared_value(spark, trees)
    packed = rows.mapInArrow(lambda batches: trimmed(_pack(shared()))(batches), LEAVES)
    blocks = settle(packed, "ann-leaves")
    return Index(trees, blocks, calibrated(blocks, trees, queries, k, recall))


def calibrated(blocks: DataFrame, trees: dict[int, Tree], queries: dict, k: int, recall: float) -> dict[int, int]:
    """For each dimension the fewest leaves that hold ``recall`` of the queries' true neighbours."""
    shared = shared_value(blocks.sparkSession, queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared()
        lists = {dim: TopLists(k, float) for dim in asked}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in lists:
                    ids, own = asked[row["dim"]]
                    block = Block.unpack(row["dim"], row["ids"], row["vectors"])
                    scores = unit(own) @ unit(block.vectors).T
                    i, j = best_of_tile(scores, (ids[:, None] != block.ids) | (ids[:, None] == NO_ID), k)
                    lists[row["dim"]].add(i, np.full(len(i), row["leaf"]), scores[i, j])
        for dim, best in lists.items():
            query, leaf, scores = best.best()
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(leaf), pa.int32()), "q": query, "leaf": leaf, "score": scores})

    found = blocks.mapInArrow(run, "dim int, q bigint, leaf bigint, score double")
    order = Window.partitionBy("dim", "q").orderBy(F.desc("score"), "leaf")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("dim", "q", "leaf").collect()
    out = {}
    for dim, tree in trees.items():
        places = [{leaf: p for p, leaf in enumerate(tree.visits(v, len(tree.leaf)))} for v in unit(queries[dim][1])]
        ranks = np.sort([places[r.q][r.leaf] for r in best if r.dim == dim])
        need = int(np.ceil(recall * len(ranks))) - 1
        out[dim] = int(ranks[need]) + 1 if len(ranks) else len(tree.leaf)
    return out


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    index: Index | None = None,
    **fit,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine) of the k nearest found."""
    spark = vectors.sparkSession
    index = index or build(vectors, id_col, vector_col, k, **fit)
    chosen = vectors.where(is_query & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).distinct()
    shared = shared_value(spark, (index.trees, index.visits))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from trimmed(_ask(*shared()))(batches)

    (size,) = index.blocks.agg(F.coalesce(F.sum(F.length("ids") * F.col("dim")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    groups = max(-(-size // MOST), min(partitions(spark), cores))
    # A walk takes long, and Spark would have few tasks for so few bytes.
    asked = chosen.repartition(4 * cores, "id", "vector").mapInArrow(visited, ASKED)
    # As many rows as the trees have leaves, and one for each further dimension.
    dealt = index.blocks.groupBy("dim", "leaf").agg(F.ceil(F.sum(F.length("ids")) / F.lit(8 * DEALT)).alias("parts"))
    group = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(groups))
    blocks = index.blocks.join(dealt, ["dim", "leaf"]).withColumn("group", group("dim", "leaf", F.pmod(F.xxhash64("ids"), F.col("parts"))))
    turns = -(-chosen.count() // TOGETHER)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, n) - 1).cast("bigint")))
    blocks = blocks.drop("parts").withColumn("turn", each(turns))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("ids", "vectors"), F.lit(max(1, turns)))).withColumn("group", each(groups))

    def run(queries: pa.Table, listed: pa.Table) -> pa.Table:
        done = pa.concat_tables([EMPTY, *search(queries, listed, k)])
        give_back()
        return done

    both = asked.groupBy("group", "turn").cogroup(blocks.groupBy("group", "turn"))
    found = both.applyInArrow(run, "query_id bigint, query bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
