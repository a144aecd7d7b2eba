"""Helpers for frames that pass through Arrow."""

import ctypes
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are whole, so a batch's bytes follow the longest ones.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: no session default bounds their bytes, only their rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_value[T](spark: SparkSession, value: T) -> Callable[[], T]:
    """Broadcast a value of bounded size; call the result once in a task to get it.

    It is packed by value, so that executors need no copy of this package.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and by then other processes need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after whose end, when nothing of it is held any more, its memory is given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def row_keys(*columns: Column) -> list[Column]:
    """128 bits that tell rows apart by value; equal rows share them, and so share results.

    A null is marked, so that a null and a value never look alike.
    """
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def join_anew(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` with a table of one row per key.

    The key's hash joins too: both sides are then shuffled for the join itself, whatever they come from, and Spark may split
    the rows of a hot key.
    """
    hashed = F.xxhash64(key)
    return rows.withColumn("_h", hashed).join(one.withColumn("_h", hashed), [key, "_h"], how).drop("_h")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
