"""Live counters."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROGRESS_INTERVAL = "2 seconds"


def running_totals(plans: DataFrame, at: str | None = None) -> DataFrame:
    """Files and bytes per action so far; state is one row per action.

    With ``at``, the column that says when a file was worked on, also its least and largest value, the seconds between
    them and the files and bytes per second over that time; these are null where no time has passed or none is known.
    """
    size = F.coalesce(F.sum("file_size"), F.lit(0))
    totals = [F.count("*").alias("files"), size.alias("bytes")]
    if at is None:
        return plans.groupBy("action").agg(*totals)
    found = plans.groupBy("action").agg(*totals, F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    first, last = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_at", "last_at"))
    found = found.withColumn("elapsed_seconds", (last - first) / 1_000_000)
    passed = F.nullif(F.col("elapsed_seconds"), F.lit(0.0))
    return found.withColumns({"files_per_second": F.col("files") / passed, "bytes_per_second": F.col("bytes") / passed})


def start_totals(
    plans: DataFrame, root: str, checkpoint: str, interval: str | None = PROGRESS_INTERVAL, at: str | None = None
) -> StreamingQuery:
    """Keep writing the running totals; each micro-batch is a complete table of its own."""

    def each(totals: DataFrame, batch_id: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = running_totals(plans, at).writeStream.outputMode("complete").foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest_totals(spark, root: str) -> DataFrame:
    """The totals of the newest micro-batch."""
    totals = spark.read.parquet(root)
    return totals.where(F.col("batch") == totals.agg(F.max("batch")).scalar()).drop("batch")
