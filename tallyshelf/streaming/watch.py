"""State of paths, with timers on event time: quiet files, watched ingest, late events.

Every rule looks at event times alone. Rows of a micro-batch are put in order first, and what has become
quiet before a row is let go before the row counts, whether or not a timer has fired meanwhile. So
results do not depend on where micro-batches begin, but for rows later than the watermark allows, which are
dropped and which ``late_events`` keeps.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import hashed, plain_path, read_files
from ..session import settle
from .buffers import in_order, micros, wait_until
from .ingest import ingest_batch

GONE = ("REMOVE", "RENAME")
#: An observation that is no event: a listing came by the file.
SEEN = "SEEN"
QUIET = "path string, events bigint, first_ts timestamp, last_ts timestamp, last_op string, file_size bigint, modified_us bigint"


def quiet_files(events: DataFrame, quiet: str = "2 seconds", delay: str = "10 seconds", shards: int = 256) -> DataFrame:
    """Files that have been quiet and unchanged for ``quiet``, with how they were last seen.

    ``events`` has ``path``, ``op``, ``ts``, ``file_size`` and ``modified_at``. An event starts the wait anew, and so
    does an observation (``SEEN``) by which size or time of the file differ from before; one of an unchanged file
    does not. Exactly ``quiet`` apart still belongs together. A file that was removed or renamed last is not let
    through. Paths are dealt to ``shards`` by their hash, as a call of Python for every path costs far more than the
    path; the state of a shard is its paths that are not quiet yet.
    """
    span = micros(quiet)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {row[0]: tuple(row[1:]) for row in state.get[0]} if state.exists else {}
        done: list[tuple] = []

        def let_go(path: str | None) -> None:
            first, last, op, size, modified, events_ = waiting.pop(path)
            if op not in GONE:
                done.append((path, events_, pd.Timestamp(first, unit="us"), pd.Timestamp(last, unit="us"), op, size, modified))

        rows = [] if state.hasTimedOut else in_order(frames, ["at", "op", "file_size", "modified_us", "path"])
        for at, op, size, modified, path in rows:
            size, modified = (v if v is None else int(v) for v in (size, modified))
            now = waiting.get(path)
            if now and at - now[1] > span:
                let_go(path)
                now = None
            if now is None:
                waiting[path] = (at, at, op, size, modified, 1)
            elif op != SEEN or (size, modified) != now[3:5]:
                waiting[path] = (min(at, now[0]), max(at, now[1]), op, size, modified, now[5] + 1)
        # no row that is still to come is older than the watermark
        mark = state.getCurrentWatermarkMs() * 1000
        for path in [path for path, now in waiting.items() if now[1] + span < mark]:
            let_go(path)
        if waiting:
            state.update(([(path, *now) for path, now in waiting.items()],))
            wait_until(state, min(now[1] for now in waiting.values()) + span)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in QUIET.split(", ")]).astype({"file_size": "Int64", "modified_us": "Int64"})

    marked = events.withWatermark("ts", delay).withColumns(
        {
            "at": F.unix_micros("ts"), "modified_us": F.unix_micros(F.col("modified_at").cast("timestamp")),
            "shard": F.pmod(F.xxhash64("path"), F.lit(shards)),
        }
    )
    state = "waiting array<struct<path string, first bigint, last bigint, op string, size bigint, modified bigint, events bigint>>"
    found = marked.groupBy("shard").applyInPandasWithState(run, QUIET, state, "append", GroupStateTimeout.EventTimeTimeout)
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}
    modified = F.timestamp_micros("modified_us").cast("timestamp_ntz")
    return found.withColumns(stamps).withColumn("modified_at", modified).drop("modified_us")


def unchanged(inventory: DataFrame, quiet: DataFrame) -> DataFrame:
    """Inventory rows of quiet files that still have the size, and the time if known, at which they became quiet.

    A file that changed meanwhile brings an event of its own; one that vanished has no row.
    """
    seen = quiet.select("path", F.col("file_size").alias("seen_size"), F.col("modified_at").alias("seen_at"))
    same_time = F.coalesce(F.col("modified_at") == F.col("seen_at"), F.lit(True))
    return inventory.join(seen, "path").where((F.col("file_size") == F.col("seen_size")) & same_time).drop("seen_size", "seen_at")


def read_quiet(quiet: DataFrame) -> DataFrame:
    """Inventory of the quiet files of a micro-batch, read and hashed; their paths pass through the driver, as any listing does."""
    spark = quiet.sparkSession
    paths = [r.path for r in quiet.select("path").distinct().collect()]
    if not paths:
        return hashed(spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary"))
    found = [p for p in paths if exists(spark, p)]
    return hashed(read_files(spark, found)) if found else read_quiet(quiet.limit(0))


def exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def watch_ingest(
    events: DataFrame,
    catalog_root: str,
    plan_root: str,
    target_root: str,
    checkpoint: str,
    quiet: str = "2 seconds",
    delay: str = "10 seconds",
    interval: str | None = None,
    read: Callable[[DataFrame], DataFrame] = read_quiet,
    **options,
) -> StreamingQuery:
    """Debounced events feed the ingest: a file is read, hashed and recorded once it is quiet and unchanged.

    ``read`` gives the inventory of the quiet files it is given; ``options`` are those of ``plan_ingest``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = settle(batch, "quiet")
        if rows.isEmpty():
            return
        ingest_batch(unchanged(read(rows), rows), batch_id, catalog_root, plan_root, target_root, **options)

    writer = quiet_files(events, quiet, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def judge_events(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds", shards: int = 8) -> DataFrame:
    """Every event with the ``watermark`` it missed, null if it came in time.

    An event is late if a burst of it alone would have ended by then. A batch's late event is late whatever else comes with it, where
    ``debounce_events`` takes one that is merged with a timely event before the shuffle; so let that have the timely ones only.
    """
    span = micros(gap)
    columns = [*events.columns, "watermark"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        for frame in frames:
            late = frame["at"] + span <= mark * 1000
            missed = pd.Series(pd.Timestamp(mark, unit="ms"), index=frame.index).where(late)
            yield frame.assign(watermark=missed)[columns]

    marked = events.withWatermark("ts", delay).withColumns(
        {"at": F.unix_micros("ts"), "shard": F.pmod(F.xxhash64("path", "ts"), F.lit(shards))}
    )
    out = T.StructType([*events.schema.fields, T.StructField("watermark", T.TimestampType())])
    return marked.groupBy("shard").applyInPandasWithState(run, out, "none int", "append", GroupStateTimeout.NoTimeout)


def late_events(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds", shards: int = 8) -> DataFrame:
    """Events that come later than ``debounce_events`` with this gap and delay allows, with the ``watermark`` they missed.

    Run it on the same source with the same rate.
    """
    return judge_events(events, gap, delay, shards).where("watermark is not null")
