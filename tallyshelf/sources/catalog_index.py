"""An index on a segmented catalog: which parts of which segments may hold a hash.

A segment lies in folders by ranges of its hashes, so many that each has about ``PER_RANGE`` records; a
small segment is one range. A range is a beginning of a digest of the hash, so ranges are even whatever the
hashes look like. Beside the segment lie two side tables:

* ``index``: per range and piece of its filter the least and the largest digest, the number of records, and
  a bitmap with one bit per record and ``BITS_PER_RECORD`` bits of room.
* ``names``: folder and name of every record's file and its hash, in order of the folder.

A batch's hashes are tried on the side table first. Only folders in which one of them may lie are listed
and read, and what is read is cut to the batch's hashes by a join that sends the batch, not the catalog.
The driver sees the names of folders to be read, never a hash.
"""

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import existing_path_column, path_names
from ..schemas import CATALOG
from .catalog_parts import SEGMENTS, Part, less_deleted, merges, part_table, tombstones

PER_RANGE, BITS_PER_RECORD = 65_536, 8
#: Hexadecimal digits that name a range, at most; and the bits of one bitmap of Spark's.
DEEPEST, BITS = 4, 32_768
WHOLE = "all"
INDEX = "range string, depth int, pieces int, piece int, first_digest string, last_digest string, records bigint, filter binary, batch bigint"
NAMES = "target_dir string, name string, hash string, batch bigint"


def digest() -> Column:
    return F.md5(F.col("hash").cast("binary"))


def range_name(key: Column | str, depth: int) -> Column:
    return F.left(F.col(key) if isinstance(key, str) else key, F.lit(depth)) if depth else F.lit(WHOLE)


def filter_place(key: str, pieces: Column) -> Column:
    """A digest's bit among all pieces of a filter, from digits that name no range."""
    return F.conv(F.substring(key, 9, 8), 16, 10).cast("bigint") % (pieces * BITS)


def depth_for(records: int) -> int:
    return min(DEEPEST, max(0, math.ceil(math.log(max(1, records) / PER_RANGE, 16))))


def write_segment(rows: DataFrame, root: str, batch: int) -> None:
    """Write the catalog records ``rows``, which should be a written table, as a segment with its side tables."""
    records = rows.count()
    depth = depth_for(records)
    laid_out = rows.select(*CATALOG.names, range_name(digest(), depth).alias("range"))
    if depth:
        laid_out = laid_out.repartition(16**depth, "range").sortWithinPartitions("range", "hash")
    else:
        laid_out = laid_out.coalesce(1).sortWithinPartitions("hash")
    laid_out.write.mode("overwrite").partitionBy("range").parquet(f"{root}/segments/batch={batch}")

    pieces = max(1, math.ceil(records / 16**depth * BITS_PER_RECORD / BITS))
    keyed = rows.select(digest().alias("key"))
    place = filter_place("key", F.lit(pieces))
    index = (
        keyed.withColumns({"range": range_name("key", depth), "piece": (F.floor(place / BITS)).cast("int"), "bit": place % BITS})
        .groupBy("range", "piece")
        .agg(
            F.min("key").alias("first_digest"), F.max("key").alias("last_digest"), F.count("*").alias("records"),
            F.bitmap_construct_agg("bit").alias("filter"),
        )
        .withColumns({"depth": F.lit(depth), "pieces": F.lit(pieces)})
    )
    index = index.select(*(c.split()[0] for c in INDEX.split(", ")[:-1]))
    index = index.orderBy("range") if depth else index.coalesce(1)
    index.write.mode("overwrite").parquet(f"{root}/index/batch={batch}")
    names = path_names(rows, existing_path_column(), "hash")
    names = names.orderBy("target_dir") if depth else names.coalesce(1).sortWithinPartitions("target_dir")
    names.write.mode("overwrite").parquet(f"{root}/names/batch={batch}")


def names_below(spark: SparkSession, root: str, folder: str, before: int | None = None) -> DataFrame:
    """(target_dir, name) of every catalogued file in or below a folder; statistics skip other folders."""
    chosen = merges(spark, root, before)
    names = part_table(spark, root, "names", NAMES, before, chosen)
    folder = folder.rstrip("/")
    names = names.where((F.col("target_dir") == folder) | F.col("target_dir").startswith(folder + "/"))
    return less_deleted(names, tombstones(spark, root, before, chosen)).select("target_dir", "name")


def hit_ranges(
    spark: SparkSession, root: str, hashes: DataFrame, before: int | None = None, chosen: list[Part] | None = None
) -> DataFrame:
    """``batch`` and ``range`` of the parts of segments in which one of the hashes may lie."""
    index = part_table(spark, root, "index", INDEX, before, chosen)
    ranges = F.array(*(range_name("key", depth) for depth in range(DEEPEST + 1)))
    probes = hashes.select(digest().alias("key")).select("key", F.explode(ranges).alias("range"))
    place = filter_place("key", F.col("pieces"))
    byte = F.conv(F.hex(F.substring("filter", (F.floor(place % BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.expr("shiftright(byte, cast(bit as int)) & 1") == 1
    tried = index.join(probes, "range").where(
        F.col("key").between(F.col("first_digest"), F.col("last_digest")) & (F.floor(place / BITS) == F.col("piece"))
    )
    return tried.withColumns({"byte": byte, "bit": place % 8}).where(set_).select("batch", "range").distinct()


def find_records(spark: SparkSession, root: str, hashes: DataFrame, before: int | None = None) -> DataFrame:
    """Records of the given hashes, of all segments or those of the batches before one.

    ``hashes`` is read twice and should be a written table.
    """
    chosen = merges(spark, root, before)
    roots = {part.high: part.root for part in chosen}
    paths: dict[str, list[str]] = defaultdict(list)
    for hit in hit_ranges(spark, root, hashes, before, chosen).orderBy("batch", "range").collect():
        place = roots.get(hit.batch, root)
        paths[f"{place}/segments"].append(f"{place}/segments/batch={hit.batch}/range={hit.range}")
    if not paths:
        return spark.createDataFrame([], CATALOG)
    wanted = hashes.select("hash")
    read = (spark.read.schema(SEGMENTS).option("basePath", base).parquet(*folders) for base, folders in paths.items())
    found = reduce(DataFrame.unionByName, read).join(wanted, "hash", "left_semi")
    gone = tombstones(spark, root, before, chosen)
    return less_deleted(found, None if gone is None else gone.join(wanted, "hash", "left_semi")).select(*CATALOG.names)
