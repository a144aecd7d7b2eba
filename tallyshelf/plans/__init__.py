"""Whole flows composed from the operators."""

from .catalogs import apply_plan, catalog_statistics, compact_catalog
from .files import ingest_folder, plan_ingest, plan_scan
from .logs import analyze_log

__all__ = ["analyze_log", "apply_plan", "catalog_statistics", "compact_catalog", "ingest_folder", "plan_ingest", "plan_scan"]
