"""Catalog after a plan, its statistics, and its maintenance."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import assign_ids, compact_catalog, delete_records, merge_catalog, to_catalog_rows
from ..operators.stats import catalog_statistics
from ..schemas import CATALOG_ACTION, MOVE, REPLACE_STALE

__all__ = ["apply_plan", "catalog_statistics", "compact_catalog", "new_records"]


def new_records(
    plan: DataFrame, after: DataFrame | int, mode: str = "ingest", processed_at: Column | str | None = None
) -> DataFrame:
    """Records of the files a plan keeps, numbered after an id or the largest one of a catalog."""
    kept = plan.where(F.col("action").isin(MOVE, CATALOG_ACTION, REPLACE_STALE))
    return assign_ids(to_catalog_rows(kept, mode, processed_at), after)


def apply_plan(
    plan: DataFrame, catalog: DataFrame, mode: str = "ingest", processed_at: Column | str | None = None
) -> DataFrame:
    """The next catalog: replaced records go, records of kept files come.

    The plan is used twice, so it should be a written table.
    """
    replaced = plan.where(F.col("action") == REPLACE_STALE).select("hash")
    return merge_catalog(delete_records(catalog, replaced), new_records(plan, catalog, mode, processed_at))
