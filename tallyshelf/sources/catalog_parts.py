"""What a segmented catalog consists of: segments, merged segments that stand for several, and tombstones.

* A segment holds the records of one batch. ``append_catalog`` writes it.
* A tombstone of a batch hides the records of its hash in all *earlier* batches, so a batch that deletes and
  adds one hash replaces it. No segment is rewritten for a delete.
* A merged segment stands for the batches ``low`` to ``high``, less what tombstones up to ``high`` hide. It counts
  as batch ``high``, so later tombstones reach it and earlier ones do not. It lies beside what it stands for and is
  announced once it is complete; whoever reads the state before ``high`` still finds the segments.

The driver sees one row per segment or merge, never a record or a hash.
"""

import math
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CATALOG

SEGMENTS = T.StructType([*CATALOG.fields, T.StructField("batch", T.LongType()), T.StructField("range", T.StringType())])
TOMBSTONES = "hash string, batch bigint"
MERGES = "low bigint, high bigint, level int"
#: The batch of the records a catalog starts with.
FIRST = -1
#: So many parts of a level are merged into one of the next.
FAN = 8


class Part(NamedTuple):
    """A segment (``low`` = ``high``) or a merged one; ``root`` is the folder its tables lie in."""

    root: str
    low: int
    high: int
    level: int


def stored(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame | None:
    """The table at ``path``, or None if there is none."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def side_table(spark: SparkSession, root: str, name: str, schema: str, before: int | None) -> DataFrame:
    """A table kept per batch, of all batches or those before one; empty if nothing was written."""
    rows = stored(spark, f"{root}/{name}", schema)
    if rows is None:
        rows = spark.createDataFrame([], schema)
    return rows if before is None else rows.where(F.col("batch") < before)


def merges(spark: SparkSession, root: str, before: int | None = None) -> list[Part]:
    """Merged segments in use, oldest first: those of batches before one that no other one contains."""
    rows = stored(spark, f"{root}/merges", MERGES, recursiveFileLookup="true")
    if rows is None:
        return []
    if before is not None:
        rows = rows.where(F.col("high") < before)
    found: list[Part] = []
    for r in sorted(rows.distinct().collect(), key=lambda r: (r.low, -r.high)):
        if not found or r.high > found[-1].high:
            found.append(Part(merged_root(root, r.low, r.high), r.low, r.high, r.level))
    return found


def merged_root(root: str, low: int, high: int) -> str:
    return f"{root}/merged/{low}_{high}"


def part_table(
    spark: SparkSession, root: str, name: str, schema: str | T.StructType, before: int | None, chosen: list[Part] | None = None
) -> DataFrame:
    """A table of all parts, with merged segments in place of what they stand for; folders of the others are not read."""
    chosen = merges(spark, root, before) if chosen is None else chosen
    rows = side_table(spark, root, name, schema, before)
    for part in chosen:
        rows = rows.where(~F.col("batch").between(part.low, part.high))
    merged = (stored(spark, f"{part.root}/{name}", schema) for part in chosen)
    return reduce(DataFrame.unionByName, (m for m in merged if m is not None), rows)


def tombstones(spark: SparkSession, root: str, before: int | None, chosen: list[Part]) -> DataFrame | None:
    """Tombstones that may still hide a record; a merge of the oldest segments has used up those before its end."""
    rows = stored(spark, f"{root}/tombstones", TOMBSTONES)
    if rows is None:
        return None
    used = max((part.high for part in chosen if part.low <= FIRST), default=FIRST)
    rows = rows.where(F.col("batch") > used)
    return rows if before is None else rows.where(F.col("batch") < before)


def less_deleted(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Rows with ``hash`` and ``batch`` that no tombstone of a later batch hides."""
    if gone is None:
        return rows
    gone = gone.select(F.col("hash").alias("gone_hash"), F.col("batch").alias("gone_in"))
    return rows.join(gone, (F.col("hash") == F.col("gone_hash")) & (F.col("batch") < F.col("gone_in")), "left_anti")


def size_level(records: int, per_part: int, fan: int) -> int:
    """Level of a segment that was not merged: 0 up to ``per_part`` records, one more for each factor of ``fan``."""
    return 0 if records <= per_part else 1 + int(math.log(records / per_part, fan))


def due(parts: list[Part], fan: int) -> tuple[list[Part], int] | None:
    """The next run of adjacent parts to merge, and the level it gets.

    A run of parts of at most level L, with no higher one between, is merged into one of level L + 1 once ``fan`` of them
    are of level L itself. So a record is rewritten at most once per level, and a large part not for a few small ones.
    """
    for level in sorted({part.level for part in parts}):
        run: list[Part] = []
        for part in [*parts, None]:
            if part is not None and part.level <= level:
                run.append(part)
                continue
            if sum(p.level == level for p in run) >= fan:
                return run, level + 1
            run = []
    return None
