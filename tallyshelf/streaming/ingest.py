"""Continuous ingest: each micro-batch is planned like a folder and recorded once."""

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import plan_ingest
from ..plans.catalogs import new_records
from ..plans.files import PLAN_COLUMNS
from ..schemas import ERROR, REPLACE_STALE
from ..session import settle
from ..sources.catalog_index import find_records, names_below
from ..sources.catalog_store import append_catalog, delete_stored, fold_segments, last_id
from .buffers import flush_buffer

FLUSH_INTERVAL = "2 seconds"
FLUSH_FILES = 50
SCHEDULE_INTERVAL = "30 seconds"


def batch_time(spark: SparkSession, root: str, batch_id: int) -> str:
    """The time of a batch, noted when it is first planned, so that a replay plans the same paths."""
    note = f"{root}/times/batch={batch_id}"
    try:
        return spark.read.schema("time string").parquet(note).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    time = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    spark.createDataFrame([(time,)], "time string").coalesce(1).write.parquet(note)
    return time


def ingest_batch(
    inventory: DataFrame,
    batch_id: int,
    catalog_root: str,
    plan_root: str,
    target_root: str,
    live: Callable[[], DataFrame] | None = None,
    fan: int | None = None,
    **options,
) -> None:
    """Plan one batch against the segments of earlier batches, then write plan and records.

    Both outputs carry the batch number. A batch that is replayed after a failure sees the
    same earlier segments, has the same time, and overwrites what it had written, so nothing is
    recorded twice. Of the catalog only the parts are read that the index names for the batch's
    hashes, and of the names in use those below the batch's own day folder, unless files are
    dated one by one. ``live`` gives the paths that exist now, anew for every batch; the record of a vanished original
    is then replaced, by a tombstone and a record of this batch. With ``fan`` the segments of earlier batches are
    folded afterwards.
    """
    spark = inventory.sparkSession
    if live is not None:
        options["live_paths"] = settle(live(), "live")
    files = settle(inventory, "inventory")
    catalog = find_records(spark, catalog_root, files.where("hash is not null").select("hash"), before=batch_id)
    processed_at = options.pop("processed_at", None)
    if processed_at is None:
        processed_at = batch_time(spark, catalog_root, batch_id)
    below = target_root.rstrip("/")
    if "date_col" not in options and isinstance(processed_at, str):
        below += "/" + processed_at[:10].replace("-", "/")
    plan = plan_ingest(files, catalog, target_root, processed_at, taken=names_below(spark, catalog_root, below, batch_id), at=settle, **options)
    plan_path = f"{plan_root}/batch={batch_id}"
    plan.write.mode("overwrite").parquet(plan_path)
    written = spark.read.schema(plan.schema).parquet(plan_path)
    added = new_records(written, last_id(spark, catalog_root, batch_id), "ingest", processed_at)
    if "live_paths" in options:
        delete_stored(written.where(F.col("action") == REPLACE_STALE), catalog_root, batch_id)
    append_catalog(settle(added, "added"), catalog_root, batch_id)
    if fan:
        fold_segments(spark, catalog_root, before=batch_id, fan=fan)


def ingest_stream(
    inventory: DataFrame,
    catalog_root: str,
    plan_root: str,
    target_root: str,
    checkpoint: str,
    interval: str | None = None,
    **options,
) -> StreamingQuery:
    """Ingest a stream of hashed files into a segmented catalog.

    With an ``interval`` it runs on; without one it works off the files that are there and
    ends, for use under an external scheduler. ``options`` are those of ``ingest_batch`` and ``plan_ingest``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, catalog_root, plan_root, target_root, **options)

    writer = inventory.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def scheduled_ingest(inventory: DataFrame, *roots: str, interval: str = SCHEDULE_INTERVAL, **options) -> StreamingQuery:
    """``ingest_stream`` now and at every interval."""
    return ingest_stream(inventory, *roots, interval=interval, **options)


def micro_batch_flush(
    inventory: DataFrame,
    *roots: str,
    interval: str | None = FLUSH_INTERVAL,
    by: str | None = None,
    limit: int = FLUSH_FILES,
    quiet: str = FLUSH_INTERVAL,
    delay: str = "10 seconds",
    shards: int = 1,
    **options,
) -> StreamingQuery:
    """``ingest_stream`` in short intervals.

    With ``by``, a time column, files pass a buffer first and are ingested when ``limit`` of them have come, or
    ``quiet`` after the last one; without it a micro-batch is what has come in an interval.
    """
    if by:
        flushed = flush_buffer(inventory, by, limit, quiet, delay, shards)
        inventory = flushed.drop(by, "shard", "flush", "reason")
    return ingest_stream(inventory, *roots, interval=interval, **options)


def quarantine_failures(listing: DataFrame, inventory: DataFrame) -> DataFrame:
    """Plan rows with action ERROR for listed files that could not be read and hashed.

    Reading is retried by Spark's own task retry before a file gets here.
    """
    failed = listing.join(inventory.select("path"), "path", "left_anti")
    text = F.lit(None).cast("string")
    return failed.select(
        "path", "name", "extension", "file_size", "modified_at",
        text.alias("hash"), text.alias("hash_type"), F.lit(ERROR).alias("action"),
        text.alias("existing_path"), text.alias("target_path"), F.lit("not readable").alias("reason"),
    ).select(*PLAN_COLUMNS)
