"""Files against the catalog. Hash and path are the only join keys there are.

A content with very many copies is split over tasks by Spark's skew handling: the catalog has one
row per hash, and both sides come from a shuffle of their own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import existing_path_column


def match_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every file with the catalog record of its hash, if there is one."""
    records = catalog.select(
        "hash", F.col("id").alias("catalog_id"), existing_path_column().alias("existing_path")
    )
    return files.join(records, "hash", "left").withColumn("known", F.col("catalog_id").isNotNull())


def known_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content is catalogued."""
    return files.join(catalog.select("hash"), "hash", "left_semi")


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content is not catalogued."""
    return files.join(catalog.select("hash"), "hash", "left_anti")


def stale_records(catalog: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Catalog records whose file is not in the live inventory, which has one row per path."""
    live = live_paths.select(F.col("path").alias("existing_path"))
    return catalog.withColumn("existing_path", existing_path_column()).join(live, "existing_path", "left_anti")


def drop_vanished(files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """Files that are still there."""
    return files.join(live_paths.select("path"), "path", "left_semi")


def taken_names(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate (target_dir, name) pairs that are already in use."""
    return candidates.join(existing.select("target_dir", "name"), ["target_dir", "name"], "left_semi")


def free_names(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate (target_dir, name) pairs nobody uses yet."""
    return candidates.join(existing.select("target_dir", "name"), ["target_dir", "name"], "left_anti")
