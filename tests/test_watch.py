"""Quiet files, flushes and late events over many micro-batches, against plain loops."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfqueries import registry
from tallyshelf.sources import catalog_store
from tallyshelf.streaming import events as bursts
from tallyshelf.streaming import buffers, ingest, watch

from .test_operators import column

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
NOW = "2024-06-01 12:00:00"
EVENTS = "path string, op string, ts timestamp, file_size bigint, modified_at timestamp_ntz"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, schema, batches, start):
    """Each batch is one run of the stream from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).awaitTermination()


def append(tmp_path, name, flow):
    return lambda stream: bursts.start_append(flow(stream), str(tmp_path / name), str(tmp_path / f"{name}-progress"))


def quiet_rows(spark, tmp_path, batches, **options):
    feed(spark, tmp_path, EVENTS, batches, append(tmp_path, "out", lambda e: watch.quiet_files(e, **options)))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted(((r.path, r.events, (r.first_ts - T0).total_seconds(), (r.last_ts - T0).total_seconds(), r.last_op, r.file_size) for r in found), key=lambda r: (r[0] or "", r[1:]))


def test_a_growing_file_is_let_through_once(spark, tmp_path):
    seen = lambda path, op, s, size: (path, op, at(s), size, at(s) if op != "SEEN" else at(0))
    batches = [
        [seen("/a", "CREATE", 0, 1), seen("/gone", "CREATE", 0, 5)],
        [seen("/a", "WRITE", 1.5, 2), seen("/gone", "REMOVE", 1, None)],
        [seen("/a", "WRITE", 3.5, 3), seen("/b", "CREATE", 4, 7), ("/b", "SEEN", at(5), 7, at(4))],
        [("/c", "CREATE", at(4.5), 1, at(4.5)), ("/c", "SEEN", at(6), 2, at(6)), (None, "CREATE", at(5), 9, None)],
        [seen("/a", "WRITE", 30, 4), seen("/end", "CREATE", 100, 0)],
    ]
    assert quiet_rows(spark, tmp_path, batches) == sorted([
        ("/a", 3, 0.0, 3.5, "WRITE", 3), ("/a", 1, 30.0, 30.0, "WRITE", 4), ("/b", 1, 4.0, 4.0, "CREATE", 7),
        ("/c", 2, 4.5, 6.0, "SEEN", 2), (None, 1, 5.0, 5.0, "CREATE", 9),
    ], key=lambda r: (r[0] or "", r[1:]))


@pytest.mark.parametrize("cut", [1, 4])
def test_micro_batches_do_not_matter(spark, tmp_path, cut):
    rng = random.Random(3)
    rows = sorted((f"/{rng.randrange(6)}", rng.choice(["CREATE", "WRITE", "REMOVE"]), at(s := round(rng.uniform(0, 200), 1)), int(s * 10), at(s)) for _ in range(150))
    rows.sort(key=lambda r: (r[2], r[0], r[1], r[3]))
    want, now = [], {}
    for path, op, ts, size, _ in rows:
        s = (ts - T0).total_seconds()
        held = now.get(path)
        if held and s - held[2] > 2 + 1e-9:
            want.append((path, *held))
            held = None
        now[path] = (held[0] + 1, held[1], s, op, size) if held else (1, s, s, op, size)
    want += [(p, *h) for p, h in now.items()]
    want = sorted(w for w in want if w[4] != "REMOVE")
    n = len(rows) // cut + 1
    batches = [rows[k : k + n] for k in range(0, len(rows), n)] + [[("/end", "CREATE", at(1000), 0, None)]]
    got = quiet_rows(spark, tmp_path, batches)
    assert [g[:2] + g[4:] for g in got] == [(w[0], w[1], w[4], w[5]) for w in want]


def test_watch_ingest_reads_a_file_when_it_is_quiet(spark, tmp_path):
    folder, where = tmp_path / "files", [str(tmp_path / n) for n in ("catalog", "plans")]
    folder.mkdir()
    catalog_store.init_segments(spark, where[0])
    names = {n: f"{folder}/{n}" for n in ("a.jpg", "b.jpg", "changed.jpg", "lost.jpg")}
    stamp = lambda s, name, size, op="WRITE": (names[name], op, at(s), size, None)

    def start(stream):
        return watch.watch_ingest(stream, *where, "/lib", str(tmp_path / "progress"), processed_at=NOW)

    (folder / "a.jpg").write_bytes(b"half")
    (folder / "changed.jpg").write_bytes(b"longer than it was seen")
    feed(spark, tmp_path, EVENTS, [[stamp(0, "a.jpg", 4, "CREATE"), stamp(0, "changed.jpg", 3), stamp(0, "lost.jpg", 3)]], start)
    (folder / "a.jpg").write_bytes(b"whole file")
    (folder / "b.jpg").write_bytes(b"whole file")
    feed(spark, tmp_path, EVENTS, [[stamp(1, "a.jpg", 10), stamp(2, "b.jpg", 10)], [(f"{folder}/end", "CREATE", at(60), 0, None)]], start)
    assert column(catalog_store.read_segments(spark, where[0]), "target_path") == ["/lib/2024/06/01/a.jpg"]
    assert sorted(r.name for r in spark.read.parquet(where[1]).collect()) == ["a.jpg", "b.jpg"]


def flushes(seconds, limit, quiet):
    out, held = [], []
    for s in seconds:
        if held and s - held[-1] > quiet + 1e-9:
            out.append(("quiet", held))
            held = []
        held = [*held, s]
        if len(held) == limit:
            out.append(("rows", held))
            held = []
    return out, held


@pytest.mark.parametrize("cut", [1, 5])
def test_flushes_by_rows_or_quiet(spark, tmp_path, cut):
    rng = random.Random(5)
    seconds, now = [], 0.0
    for _ in range(120):
        now += rng.choice([0.1, 0.5, 1.0, 2.0, 2.5, 4.0])
        seconds.append(round(now, 1))
    rows = [(f"p{k}", at(s), None if k % 3 else "odd \n text", T0) for k, s in enumerate(seconds)]
    n = len(rows) // cut + 1
    batches = [rows[k : k + n] for k in range(0, len(rows), n)] + [[("end", at(10_000), None, T0)]]
    schema = "path string, ts timestamp, note string, plain timestamp_ntz"
    feed(spark, tmp_path, schema, batches, append(tmp_path, "out", lambda e: buffers.flush_buffer(e, limit=7)))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.path, r.ts, r.note, r.plain) for r in found.collect()} == set(rows)
    got = {}
    for r in found.collect():
        got.setdefault((r.flush, r.reason), []).append(round((r.ts - T0).total_seconds(), 1))
    want, left = flushes(seconds, 7, 2)
    want += [("quiet", left)] if left else []
    assert [(k[1], sorted(v)) for k, v in sorted(got.items())] == want


def test_buffered_ingest_takes_files_by_rows_or_quiet(spark, tmp_path):
    where = [str(tmp_path / n) for n in ("catalog", "plans")]
    catalog_store.init_segments(spark, where[0])
    schema = "path string, name string, extension string, file_size bigint, modified_at timestamp_ntz, hash string, hash_type string, ts timestamp"
    row = lambda k, s: (f"/s/{k}.jpg", f"{k}.jpg", ".jpg", k, at(k / 7), f"h{k}", "sha256", at(s))
    counts = []

    def start(stream):
        counts.append(catalog_store.read_segments(spark, where[0]).count())
        return ingest.micro_batch_flush(stream, *where, "/lib", str(tmp_path / "progress"), interval=None, by="ts", limit=3, processed_at=NOW)

    batches = [[row(k, k / 10) for k in range(4)], [row(4, 0.5)], [row(5, 0.6)], [row(6, 60)], [row(7, 1000)]]
    feed(spark, tmp_path, schema, batches, start)
    assert counts == [0, 3, 3, 6, 6] and catalog_store.read_segments(spark, where[0]).count() == 7


def test_shards_keep_every_row(spark, tmp_path):
    rows = [(f"p{k}", at(k / 10)) for k in range(200)]
    feed(spark, tmp_path, "path string, ts timestamp", [rows, [("end", at(9999))]], append(tmp_path, "out", lambda e: buffers.flush_buffer(e, limit=10, shards=3)))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert column(found.where("path <> 'end'"), "path") == sorted(p for p, _ in rows)
    assert max(r["count"] for r in found.groupBy("shard", "flush").count().collect()) == 10


def test_late_events_are_those_that_bursts_leave_out(spark, tmp_path):
    rng = random.Random(9)
    batches = [[(f"/{rng.randrange(20)}", "WRITE", at(max(0.0, b * 30 + rng.uniform(0, 30) - (rng.random() < 0.2) * 45))) for _ in range(40)] for b in range(6)]
    batches.append([("/end", "CREATE", at(10_000))])

    def start(stream):
        append(tmp_path, "late", lambda e: watch.late_events(e, "2 seconds", "10 seconds"))(stream).awaitTermination()
        return append(tmp_path, "out", lambda e: bursts.debounce_events(e, "2 seconds", "10 seconds"))(stream)

    feed(spark, tmp_path, "path string, op string, ts timestamp", batches, start)
    late = spark.read.parquet(str(tmp_path / "late"))
    counted = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).first()[0]
    mark, want = None, []
    for rows in batches:
        want += [(p, ts) for p, _, ts in rows if mark and ts + dt.timedelta(seconds=2) <= mark]
        newest = max(ts for _, _, ts in rows).replace(microsecond=0)
        mark = max(mark or newest, newest - dt.timedelta(seconds=10))
    got = sorted((r.path, r.ts) for r in late.collect())
    assert len(got) > 5 and counted + len(got) == 240
    assert abs(len(got) - len(want)) <= 3 and all(r.ts + dt.timedelta(seconds=2) <= r.watermark for r in late.collect())


def test_a_late_event_beside_a_timely_one_is_late_only(spark, tmp_path):
    """Merged before the shuffle, the two were one burst that had not ended, so the late one was counted in it as well."""
    rows = [(i, 9, at(i), "view") for i in range(20)]
    rows[2], rows[3] = (2, 1, at(-2700), "view"), (3, 1, at(-1200), "view")  # the first part's watermark is ten minutes before noon
    table = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string")
    table.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.late_event_policy(spark, str(tmp_path)).where("path = '/src/1.jpg'").collect()
    assert sorted((r.events, r.first_ts, r.watermark is None) for r in found) == [(0, at(-2700), False), (1, at(-1200), True)]


def test_many_paths_share_the_state_of_few_shards(spark, tmp_path):
    """A call of Python for every path made the state as many rows as paths."""
    schema = "path string, op string, ts timestamp, file_size bigint, modified_at timestamp_ntz"
    paths = [f"/{i}.jpg" for i in range(40)]
    batches = [[(p, "CREATE", at(0), i, None) for i, p in enumerate(paths)], [("/end.jpg", "CREATE", at(999), None, None)]]
    feed(spark, tmp_path, schema, batches, append(tmp_path, "out", lambda e: watch.quiet_files(e, shards=4)))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {r.path: r.file_size for r in found.collect()} == {p: i for i, p in enumerate(paths)}
    states = spark.read.format("statestore").load(str(tmp_path / "out-progress"))
    assert states.count() <= 4


def test_only_rows_at_one_time_are_ordered_by_value():
    frames = [pd.DataFrame({"at": [2, 1, 1], "payload": ["a", "z", "b"]}), pd.DataFrame({"at": [1, 0], "payload": ["c", "y"]})]
    assert buffers.by_time(iter(frames), "at", "payload").values.tolist() == [[0, "y"], [1, "b"], [1, "c"], [1, "z"], [2, "a"]]
