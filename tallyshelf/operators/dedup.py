"""Which of several equal files is the one to keep."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walk_key, walked_path


def survivors(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Per hash the first path in walk order, its ``carry`` columns, and the number of copies.

    A plain aggregate: copies are folded on the map side, so a hash with very many copies
    sends one row per task over the network.
    """
    key = walk_key("path")
    first = F.min(F.struct(key.alias("key"), *carry) if carry else key)
    folded = files.groupBy("hash").agg(first.alias("first"), F.count("*").alias("copies"))
    path = walked_path("first.key" if carry else "first").alias("kept_path")
    return folded.select("hash", path, *(f"first.{c}" for c in carry), "copies")


def dedup_keep_first(files: DataFrame) -> DataFrame:
    """The first file of each hash in walk order; a file without a hash is equal to no other and stays.

    Spark keeps one row per hash in every task before it shuffles (window group limit).
    """
    first = F.row_number().over(Window.partitionBy("hash").orderBy(walk_key("path")))
    kept = files.where("hash is not null").withColumn("place", first).where("place = 1").drop("place")
    return kept.unionByName(files.where("hash is null"))


def dedup_keep_last(catalog: DataFrame) -> DataFrame:
    """The record with the highest id of each hash."""
    last = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("id")))
    return catalog.withColumn("place", last).where("place = 1").drop("place")


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Every file with the path that survives for its content and the number of copies.

    ``files`` should be a written table: it is folded per content first, and joined then. The
    folded side is dealt anew, so that Spark may split a content with very many copies. A file
    without a hash has no copies.
    """
    hashed = files.where("hash is not null")
    joined = hashed.join(survivors(hashed).hint("rebalance"), "hash")
    alone = files.where("hash is null").withColumns({"kept_path": F.col("path"), "copies": F.lit(1).cast("bigint")})
    return joined.unionByName(alone).withColumn("is_duplicate", F.col("path") != F.col("kept_path"))
