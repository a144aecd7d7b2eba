"""Exact top-k search by tiled matrix products.

Vectors are packed into shards and queries into blocks, each one row. Every block of queries meets
every shard once, in a join on groups of shards: a tile. A tile is one matrix product with a partial
selection of each query's best; a task merges the lists of its tiles, and the lists of all tasks
are merged per query, by a rank with a limit that already applies before the shuffle.

Scores are inner products of floor(scale * x), x in double precision, in integers: products of
doubles where those are exact, else of integers of any size, and cut to 64 bits.

Defined results: vectors that are null, or hold null, NaN or infinity, take no part. Only vectors of
one length are compared; empty ones score 0. A row without an id is a candidate, after all others in
ties, and never a query. A query is not compared with rows of its own id. Rows that repeat a
query's id and vector make one query; rows that repeat an id with another vector each make one.
Repeated candidates each count. Other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import partitions, small_batches
from ._vectors import PACKED, Block, TopLists, best_of_tile, hash_of, ids_array, pack

#: Vectors of a shard and queries of a block.
SHARD, QUERIES = 4096, 256
#: Blocks of queries whose lists a task keeps before it sends them on.
HELD = 64


def products(queries: np.ndarray, shard: np.ndarray, scale: float) -> np.ndarray:
    """Integer inner products of all pairs."""
    a, b = np.floor(queries * scale), np.floor(shard * scale)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    scale: float = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's k best."""
    spark = vectors.sparkSession
    small_batches(spark)
    groups = partitions(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    chosen = vectors.where(is_query & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).distinct()
    shards = rows.mapInArrow(pack(SHARD), PACKED).withColumn("part", F.pmod(F.xxhash64("ids", "vectors"), F.lit(groups)))
    blocks = chosen.mapInArrow(pack(QUERIES), PACKED).select(
        F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    spread = blocks.withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    # Spark counts the copies of a block as one row, and would take all of them for small enough to broadcast.
    tiles = spread.join(shards.hint("merge"), (F.col("q_dim") == F.col("dim")) & (F.col("q_part") == F.col("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[bytes, bytes], tuple[np.ndarray, TopLists]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (ids, values), (names, best) in lists.items():
                keys = np.frombuffer(values, np.uint8).reshape(len(names), -1)
                own = [hash_of(row.tobytes()) for row in keys]
                query, found, scores = best.best()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[query]), pa.array(np.array(own, np.int64)[query]), ids_array(found), pa.array(scores)],
                    ["query_id", "query", "vec_id", "score"],
                )

        for batch in batches:
            for row in range(batch.num_rows):
                (tile,) = batch.slice(row, 1).to_pylist()
                key = (tile["q_ids"], tile["q_vectors"])
                queries, shard = Block.unpack(tile["dim"], *key), Block.unpack(tile["dim"], tile["ids"], tile["vectors"])
                if key not in lists:
                    if len(lists) >= HELD:
                        yield from sent()
                        lists.clear()
                    lists[key] = (queries.ids, TopLists(k, np.int64))
                scores = products(queries.vectors, shard.vectors, scale)
                i, j = best_of_tile(scores, queries.ids[:, None] != shard.ids, k)
                lists[key][1].add(i, shard.ids[j], scores[i, j])
        yield from sent()

    found = tiles.mapInArrow(run, "query_id bigint, query bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
