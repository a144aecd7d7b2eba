"""File events: debouncing, vanished files, late events."""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: One stateful operator a query: what is late is then told by the watermark that also closes bursts.
MANY_STATES = "spark.sql.streaming.statefulOperator.allowMultiple"
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def debounce_events(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """One row per path and burst of events, once the path has been quiet for ``gap``.

    Each event restarts the wait; events exactly ``gap`` apart belong together. Of events at
    the same time the alphabetically last operation counts as the last one. ``delay`` is how
    late an event may come: what is later is dropped, and counted by a ``LateCounter``. A table gives all its
    bursts; a stream gives a burst once its watermark has passed it.
    """
    last = F.max(F.struct("ts", "op"))
    return (
        events.withWatermark("ts", delay)
        .groupBy("path", F.session_window("ts", gap).alias("burst"))
        .agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), last.alias("last"))
        .select(
            "path",
            "events",
            F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
            F.col("last.ts").cast("timestamp_ntz").alias("last_ts"),
            F.col("last.op").alias("last_op"),
        )
    )


def drop_vanished_events(bursts: DataFrame) -> DataFrame:
    """Bursts that did not end with the file's removal."""
    return bursts.where(F.col("last_op") != "REMOVE")


def start_append(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write finished rows of a stream as Parquet.

    With an ``interval`` it runs on; without one it works off what is there and ends. Bursts
    are merged within each task before the shuffle, so that a path with very many events sends
    few rows.
    """
    stream.sparkSession.conf.set(LOCAL_MERGE, "true")
    stream.sparkSession.conf.set(MANY_STATES, "false")
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class LateCounter(StreamingQueryListener):
    """Rows each query has dropped for being later than the watermark allows, over its whole run.

    Register it with ``spark.streams.addListener`` before the query starts.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for operator in event.progress.stateOperators:
            self.dropped[str(event.progress.id)] += operator.numRowsDroppedByWatermark

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
