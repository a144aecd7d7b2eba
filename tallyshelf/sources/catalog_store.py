"""Catalogs on Parquet: immutable snapshots, append-only segments, and JDBC for migration.

A snapshot is written beside the ones before it and then announced in ``commits``, so a
writer that dies half-way leaves nothing a reader would see, and nobody ever overwrites
what is being read. A streaming job adds segments instead, one per micro-batch; a replayed
batch overwrites its own segment and nothing else. Deletes are tombstones, and small segments are
folded into larger ones (``catalog_parts``).
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import compact_catalog
from ..schemas import CATALOG
from ..session import settle
from . import catalog_index
from .catalog_parts import (
    FAN, FIRST, MERGES, SEGMENTS, Part, due, less_deleted, merged_root, merges, part_table, side_table, size_level, tombstones,
)


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows in the order that lets Parquet statistics skip data for per-extension queries."""
    return rows.select(*CATALOG.names).sortWithinPartitions("extension", "processed_at")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    (
        rows.write.mode(mode)
        .option("parquet.bloom.filter.enabled#hash", "true")
        .parquet(path)
    )


def write_snapshot(catalog: DataFrame, root: str, version: int) -> str:
    """Write a whole catalog as snapshot ``version`` and announce it.

    What a writer that died has left of this version is replaced; an announced version is not.
    """
    spark = catalog.sparkSession
    if version <= latest_version(spark, root):
        raise ValueError(f"snapshot {version} of {root} is not newer than the latest one")
    path = f"{root}/v={version}"
    _write(_laid_out(catalog), path, "overwrite")
    spark.range(version, version + 1).coalesce(1).write.parquet(f"{root}/commits/v={version}")
    return path


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest announced snapshot, -1 if there is none."""
    try:
        commits = spark.read.schema("id bigint").option("recursiveFileLookup", "true").parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return -1
        raise
    return commits.agg(F.max("id")).first()[0]


def read_catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A snapshot; the newest one unless told otherwise."""
    version = latest_version(spark, root) if version is None else version
    return spark.read.schema(CATALOG).parquet(f"{root}/v={version}")


def append_catalog(rows: DataFrame, root: str, batch: int) -> str:
    """Add records, a written table, as the indexed segment of ``batch``, and note the largest id up to it.

    Repeating the call for a batch changes nothing.
    """
    catalog_index.write_segment(rows, root, batch)
    before = last_id(rows.sparkSession, root, batch) if batch >= 0 else 0
    largest = F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(before)).cast("bigint")
    rows.agg(largest.alias("last_id")).write.mode("overwrite").parquet(f"{root}/ids/batch={batch}")
    return f"{root}/segments/batch={batch}"


def delete_stored(hashes: DataFrame, root: str, batch: int) -> None:
    """Delete the records of the given hashes in all batches before ``batch``, without rewriting a segment.

    Goes together with ``append_catalog`` for the same batch, whose records stay: an empty one for a plain
    delete. Null hashes hit nothing. Repeating the call for a batch changes nothing.
    """
    wanted = hashes.select("hash").where("hash is not null").distinct()
    wanted.write.mode("overwrite").parquet(f"{root}/tombstones/batch={batch}")


def replace_stored(rows: DataFrame, root: str, batch: int) -> None:
    """Records ``rows``, a written table, in place of what earlier batches have of their hashes."""
    delete_stored(rows, root, batch)
    append_catalog(rows, root, batch)


def init_segments(spark: SparkSession, root: str, catalog: DataFrame | None = None) -> None:
    """Start a segmented catalog with the given records, or with none."""
    append_catalog(spark.createDataFrame([], CATALOG) if catalog is None else catalog, root, FIRST)


def _records(spark: SparkSession, root: str, before: int | None) -> DataFrame:
    """Records less the deleted ones, with the batch of their part."""
    chosen = merges(spark, root, before)
    return less_deleted(part_table(spark, root, "segments", SEGMENTS, before, chosen), tombstones(spark, root, before, chosen))


def read_segments(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Records of all batches, or of those before one, less the deleted; the scan does not open other segments."""
    return _records(spark, root, before).drop("batch", "range")


def catalog_parts(spark: SparkSession, root: str, before: int | None = None, fan: int = FAN) -> list[Part]:
    """The segments and merged segments that make up the catalog, oldest first."""
    chosen = merges(spark, root, before)
    batches = side_table(spark, root, "ids", "last_id bigint, batch bigint", before).select("batch")
    for part in chosen:
        batches = batches.where(~F.col("batch").between(part.low, part.high))
    sizes = side_table(spark, root, "index", catalog_index.INDEX, before).groupBy("batch").agg(F.sum("records").alias("records"))
    found = batches.join(sizes, "batch", "left").collect()
    plain = [Part(root, r.batch, r.batch, size_level(r.records or 0, catalog_index.PER_RANGE, fan)) for r in found]
    return sorted([*plain, *chosen], key=lambda part: part.high)


def merge_parts(spark: SparkSession, root: str, parts: list[Part], level: int, newest_only: bool = False) -> Part:
    """Write adjacent parts as one, less what tombstones up to its end hide, and announce it.

    With ``newest_only`` a hash that several of the parts have keeps its record of the highest id.
    """
    low, high = parts[0].low, parts[-1].high
    merged = Part(merged_root(root, low, high), low, high, level)
    rows = _records(spark, root, high + 1).where(F.col("batch") >= low).select(*CATALOG.names)
    rows = settle(compact_catalog(rows).select(*CATALOG.names) if newest_only else rows, "merged")
    catalog_index.write_segment(rows, merged.root, high)
    note = spark.createDataFrame([(low, high, level)], MERGES).coalesce(1)
    note.write.mode("overwrite").parquet(f"{root}/merges/{low}_{high}")
    return merged


def fold_segments(
    spark: SparkSession, root: str, before: int | None = None, fan: int = FAN, newest_only: bool = False
) -> list[Part]:
    """Merge segments in levels until no ``fan`` parts of one level are left in a row; gives what was merged.

    For the one writer of a catalog, which passes the number of the batch it is at as ``before``: that batch may be
    replayed and stays as it is. Readers go on meanwhile. A fold that dies is started anew.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    parts, done = catalog_parts(spark, root, before, fan), []
    if parts:
        parts[0] = parts[0]._replace(low=min(FIRST, parts[0].low))
    while chosen := due(parts, fan):
        run, level = chosen
        done.append(merge_parts(spark, root, run, level, newest_only))
        place = parts.index(run[0])
        parts[place : place + len(run)] = [done[-1]]
    return done


def last_id(spark: SparkSession, root: str, before: int) -> int:
    """Largest id of the batches before one: the note of the last batch has it. No segment is read."""
    schema = "last_id bigint"
    try:
        return spark.read.schema(schema).parquet(f"{root}/ids/batch={before - 1}").first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return side_table(spark, root, "ids", f"{schema}, batch bigint", before).agg(F.max("last_id")).first()[0] or 0


def read_catalog_jdbc(
    spark: SparkSession, url: str, table: str, ids: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """A catalog kept in a database, read in parallel by ranges of its id."""
    rows = (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=ids[0], upperBound=ids[1], **options)
        .option("numPartitions", partitions)
        .load()
    )
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CATALOG.fields))


def append_catalog_jdbc(rows: DataFrame, url: str, table: str, batch_size: int = 50, **options: str) -> None:
    """Add records to a database table, ``batch_size`` rows per insert; the database numbers them."""
    columns = [c for c in CATALOG.names if c != "id"]
    rows.select(*columns).write.format("jdbc").options(url=url, dbtable=table, **options).option(
        "batchsize", batch_size
    ).mode("append").save()
