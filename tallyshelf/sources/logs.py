"""Log text and file events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FILE_EVENTS


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as ``value``, without the space around them."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files as they arrive."""
    return spark.readStream.text(path).select(F.trim("value").alias("value"))


def file_event_stream(
    spark: SparkSession,
    path: str,
    fmt: str = "json",
    schema: T.StructType = FILE_EVENTS,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of file events (path, op, ts) from event files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
