"""A buffer in state that flushes by rows or by quiet, and what timers on event time need.

Rows of a micro-batch are put in order first, and a quiet time that has passed before a row is seen whether or
not a timer has fired meanwhile, so flushes do not depend on where micro-batches begin.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def micros(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


def wait_until(state: GroupState, at: int) -> None:
    """Set a timer that fires once the watermark has passed ``at``, in microseconds."""
    state.setTimeoutTimestamp(max(at // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Rows of one key of a micro-batch, by time and then by value; missing values as None."""
    rows = pd.concat(list(frames), ignore_index=True)[columns].astype(object)
    rows = rows.where(rows.notna(), None)
    return sorted(rows.itertuples(index=False, name=None), key=lambda r: (r[0], *(str(v) for v in r[1:])))


def by_time(frames: Iterator[pd.DataFrame], time: str, value: str) -> pd.DataFrame:
    """Rows of one key of a micro-batch, by time and then by value; only rows at the same time are compared by value."""
    rows = pd.concat(list(frames), ignore_index=True)[[time, value]].sort_values(time, kind="stable", ignore_index=True)
    tied = rows[time].duplicated(keep=False)
    if tied.any():
        rows.loc[tied] = rows[tied].sort_values([time, value]).to_numpy()
    return rows


def flush_buffer(
    rows: DataFrame, at: str = "ts", limit: int = 50, quiet: str = "2 seconds", delay: str = "10 seconds", shards: int = 1
) -> DataFrame:
    """Rows in flushes of ``limit``, or of what there is after ``quiet`` without a row, whichever comes first.

    Adds ``shard``, ``flush`` (from 1 within a shard) and ``reason`` (``rows`` or ``quiet``). A buffer is the state of
    one shard and holds fewer than ``limit`` rows; rows are dealt to shards by their value. With one shard
    flushes follow the order of all rows.
    """
    span = micros(quiet)
    out = "shard bigint, flush bigint, reason string, payload string"
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, flushes = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, 0)
        if state.hasTimedOut:
            found = pd.DataFrame({"payload": held}).assign(shard=key[0], flush=flushes + 1, reason="quiet")
            held, flushes = [], flushes + bool(held)
        else:
            new = by_time(frames, "at", "payload")
            payloads, times = np.concatenate([np.array(held, dtype=object), new["payload"].to_numpy(object)]), new["at"].to_numpy(np.int64)
            newest = np.maximum.accumulate(np.concatenate([[last], times]))
            starts = np.concatenate([np.zeros(len(held), bool), times - newest[:-1] > span])
            place = np.arange(len(payloads))
            place -= np.maximum.accumulate(np.where(starts, place, 0))  # within a stretch without quiet
            number = np.cumsum(place % limit == 0)
            sizes = np.bincount(number)[1:]
            done = len(sizes) - (sizes[-1] < limit)
            reasons = np.where(sizes == limit, "rows", "quiet")
            out_ = number <= done
            found = pd.DataFrame(
                {"shard": key[0], "flush": flushes + number[out_], "reason": reasons[number[out_] - 1], "payload": payloads[out_]}
            )
            held, last, flushes = payloads[~out_].tolist(), int(newest[-1]), flushes + int(done)
        state.update((held, last, flushes))
        if held:
            wait_until(state, last + span)
        if len(found):
            yield found[names]

    whole = F.struct(*rows.columns)
    packed = rows.withWatermark(at, delay).select(
        F.col(at), F.unix_micros(F.col(at)).alias("at"), F.pmod(F.xxhash64(*rows.columns), F.lit(shards)).alias("shard"),
        F.to_json(whole, STAMPS | {"ignoreNullFields": "false"}).alias("payload"),
    )
    state = "held array<string>, last bigint, flushes bigint"
    found = packed.groupBy("shard").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("payload", T.StructType(rows.schema.fields), STAMPS).alias("row"), "shard", "flush", "reason").select(
        "row.*", "shard", "flush", "reason"
    )
