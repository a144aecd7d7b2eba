"""Catalog records: building, querying, checking, merging and compacting them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import base_name, file_extension
from ..schemas import CATALOG, COLUMN_LIMITS
from .dedup import dedup_keep_last

ID_BUCKET_DIGITS = 4


def timestamp_column(value: Column | str | None) -> Column:
    """A given time, as a column or as text, without zone; the current time if none is given."""
    if value is None:
        value = F.current_timestamp()
    elif isinstance(value, str):
        value = F.lit(value)
    return value.cast("timestamp_ntz")


def to_catalog_rows(
    files: DataFrame,
    mode: str = "ingest",
    processed_at: Column | str | None = None,
    target_path: str = "target_path",
) -> DataFrame:
    """Records of new files, still without an id.

    Ingest stamps ``created_at`` with the processing time and keeps the given target path;
    scan takes the file's own time, and the file stays where it is.
    """
    if mode not in ("ingest", "scan"):
        raise ValueError(f"mode must be 'ingest' or 'scan', not {mode!r}")
    now = timestamp_column(processed_at)
    return files.select(
        "hash",
        base_name("path").alias("original_name"),
        F.col("file_size").cast("bigint").alias("file_size"),
        file_extension("path").alias("extension"),
        (now if mode == "ingest" else F.col("modified_at").cast("timestamp_ntz")).alias("created_at"),
        now.alias("processed_at"),
        F.col("path").alias("source_path"),
        (F.col(target_path) if mode == "ingest" else F.col("path")).alias("target_path"),
        "hash_type",
    )


def existing_path_column() -> Column:
    """Where a catalogued file is: its target path, or its source path if that is empty."""
    return F.coalesce(F.nullif(F.col("target_path"), F.lit("")), F.col("source_path"))


def existing_path(catalog: DataFrame) -> DataFrame:
    """Catalog with ``existing_path`` added."""
    return catalog.withColumn("existing_path", existing_path_column())


def path_names(paths: DataFrame, path: Column | str = "path", *more: str) -> DataFrame:
    """(target_dir, name) of every path, and any other columns asked for."""
    path = F.col(path) if isinstance(path, str) else path
    name = base_name(path)
    return paths.select(F.left(path, F.length(path) - F.length(name) - 1).alias("target_dir"), name.alias("name"), *more)


def names_in_use(catalog: DataFrame, below: str | None = None) -> DataFrame:
    """(target_dir, name) of every catalogued file, or of those below a folder.

    The folder is tested on the stored columns, where Parquet statistics can skip whole files.
    """
    if below:
        prefix = below.rstrip("/") + "/"
        catalog = catalog.where(F.col("target_path").startswith(prefix) | F.col("source_path").startswith(prefix))
    return path_names(catalog, existing_path_column())


def files_by_extension(catalog: DataFrame, extension: str, limit: int) -> DataFrame:
    """Newest records of one extension; the top ``limit`` is kept per task, then merged."""
    return catalog.where(F.col("extension") == extension).orderBy(F.desc("processed_at"), "id").limit(limit)


def largest_files(catalog: DataFrame, k: int, per_extension: bool = False) -> DataFrame:
    """The ``k`` largest files, overall or of each extension."""
    order = [F.desc("file_size"), F.asc("id")]
    if not per_extension:
        return catalog.orderBy(*order).limit(k)
    ranked = catalog.withColumn("rank", F.row_number().over(Window.partitionBy("extension").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def merge_catalog(catalog: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Catalog and new records together."""
    return catalog.unionByName(new_rows)


def delete_records(catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    """Catalog without the given hashes."""
    return catalog.join(hashes, "hash", "left_anti")


def deletion_report(catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per requested hash how many records go; a hash that hits none carries a warning."""
    wanted = hashes.select("hash").distinct()
    removed = catalog.select("hash").groupBy("hash").agg(F.count("*").alias("found"))
    found = F.coalesce("found", F.lit(0)).cast("bigint")
    return wanted.join(removed, "hash", "left").select(
        "hash", found.alias("rows_affected"), F.when(found == 0, "no such record").alias("warning")
    )


def replace_stale(catalog: DataFrame, replacements: DataFrame) -> DataFrame:
    """Catalog with the records of the replaced hashes exchanged for new ones."""
    return merge_catalog(delete_records(catalog, replacements.select("hash")), replacements)


def assign_ids(new_rows: DataFrame, after: DataFrame | int = 0) -> DataFrame:
    """Number new records in hash order, after a given id or the largest id of a catalog.

    Hashes are unique here and evenly spread, so their leading hex digits cut the rows into
    65,536 even buckets. Each bucket is numbered on its own and shifted by the count of the
    buckets before it; only those bucket counts ever meet in one task. The numbering depends
    on nothing but the data, so a rerun task hands out the same ids.
    """
    bucketed = new_rows.withColumn("bucket", F.left("hash", F.lit(ID_BUCKET_DIGITS)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    start = F.lit(after) if isinstance(after, int) else after.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("hash"))
    return (
        bucketed.withColumn("place", place)
        .join(F.broadcast(offsets), "bucket")
        .withColumn("id", (start + F.col("offset") + F.col("place")).cast("bigint"))
        .select(*CATALOG.names)
    )


def check_catalog(catalog: DataFrame) -> DataFrame:
    """Violations per constraint: repeated hashes, missing values, over-long text.

    Counting per hash first lets every check share one pass and one shuffle.
    """
    required = [f.name for f in CATALOG.fields if not f.nullable]
    checks = {f"not_null_{c}": F.col(c).isNull() for c in required}
    checks |= {f"max_length_{c}": F.length(c) > n for c, n in COLUMN_LIMITS.items()}
    per_hash = catalog.groupBy("hash").agg(
        F.count("*").alias("copies"), *(F.count_if(test).alias(name) for name, test in checks.items())
    )
    totals = per_hash.agg(
        F.count_if((F.col("copies") > 1) & F.col("hash").isNotNull()).alias("unique_hash"),
        *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in checks),
    )
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in ["unique_hash", *checks]))
    return totals.select(F.inline(rows))


def compact_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog with only the record of the highest id per hash."""
    return dedup_keep_last(catalog)
