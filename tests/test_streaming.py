import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shelfqueries import registry
from tallyshelf.operators import filters
from tallyshelf.operators.catalog import names_in_use
from tallyshelf.operators.dedup import dedup_keep_first
from tallyshelf.schemas import FILE_EVENTS
from tallyshelf.sources import catalog_index, catalog_store, files, logs
from tallyshelf.streaming import events, ingest, progress

from .test_operators import column, inventory, records

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
NOW = "2024-06-01 12:00:00"


def drop_events(folder, name, rows):
    """One file of events (path, op, seconds after noon)."""
    folder.mkdir(exist_ok=True)
    text = "\n".join(
        json.dumps({"path": p, "op": op, "ts": (T0 + dt.timedelta(seconds=s)).isoformat()}) for p, op, s in rows
    )
    (folder / name).write_text(text)


def wait_for_listeners(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)


def bursts(spark, tmp_path, flow, batches):
    """Feed files of events one per micro-batch; gives the rows written and the late rows dropped."""
    for i, rows in enumerate(batches):
        drop_events(tmp_path / "in", f"{i}.json", rows)
    stream = flow(logs.file_event_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1))
    counter = events.LateCounter()
    spark.streams.addListener(counter)
    try:
        query = events.start_append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        wait_for_listeners(spark)
    finally:
        spark.streams.removeListener(counter)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), counter.dropped[str(query.id)]


def test_debounce(spark, tmp_path):
    rows = [
        ("/a.jpg", "CREATE", 0.0), ("/a.jpg", "WRITE", 1.0), ("/a.jpg", "WRITE", 3.0), ("/a.jpg", "WRITE", 5.1),
        ("/b.jpg", "CREATE", 0.0), ("/b.jpg", "REMOVE", 0.5), ("/end.jpg", "CREATE", 100.0),
    ]
    found, _ = bursts(spark, tmp_path, events.debounce_events, [rows])
    got = sorted((r.path, r.events, (r.last_ts - T0).total_seconds(), r.last_op) for r in found.collect())
    assert got == [("/a.jpg", 1, 5.1, "WRITE"), ("/a.jpg", 3, 3.0, "WRITE"), ("/b.jpg", 2, 0.5, "REMOVE")]
    assert column(events.drop_vanished_events(found), "path") == ["/a.jpg", "/a.jpg"]


def test_bursts_grow_across_batches_and_late_events_are_counted(spark, tmp_path):
    batches = [
        [("/a.jpg", "CREATE", 50.0)], [("/a.jpg", "WRITE", 51.5)], [("/end.jpg", "CREATE", 100.0)],
        [("/late.jpg", "CREATE", 10.0)], [("/end2.jpg", "CREATE", 200.0)],
    ]
    found, late = bursts(spark, tmp_path, events.debounce_events, batches)
    got = {(r.path, r.events) for r in found.collect()}
    assert got == {("/a.jpg", 2), ("/end.jpg", 1)}
    assert late == 1


def test_a_longer_delay_keeps_late_events(spark, tmp_path):
    batches = [[("/x.jpg", "CREATE", 100.0)], [("/late.jpg", "CREATE", 10.0)], [("/end.jpg", "CREATE", 1000.0)]]
    found, late = bursts(spark, tmp_path, lambda e: events.debounce_events(e, delay="5 minutes"), batches)
    assert column(found, "path") == ["/late.jpg", "/x.jpg"]
    assert late == 0


def test_hot_path_is_folded_before_the_shuffle(spark, tmp_path):
    drop_events(tmp_path / "in", "0.json", [("/hot.jpg", "WRITE", i / 10) for i in range(300)])
    stream = events.debounce_events(logs.file_event_stream(spark, str(tmp_path / "in")))
    query = events.start_append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.index("Exchange hashpartitioning") < plan.rindex("MergingSessions")


def test_event_filter_on_a_stream(spark, tmp_path):
    rows = [("/a.jpg", "CREATE", 0), ("/a.txt", "CREATE", 0), ("/b.PNG", "WRITE", 1), ("/c.jpg", "REMOVE", 2), ("/d.jpg", "RENAME", 2)]
    found, _ = bursts(spark, tmp_path, filters.filter_events, [rows])
    assert column(found, "path") == ["/a.jpg", "/b.PNG"]
    assert found.schema["ts"].dataType == FILE_EVENTS["ts"].dataType


def roots(spark, tmp_path, store=None):
    found = [str(tmp_path / name) for name in ("catalog", "plans")]
    catalog_store.init_segments(spark, found[0], store)
    return [*found, "/lib", str(tmp_path / "checkpoint")]


def feed(tmp_path, names):
    for name, content in names.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)


def run(spark, tmp_path, where, per_trigger=None, **options):
    stream = files.hashed(files.new_file_stream(spark, str(tmp_path / "in"), ["jpg"], per_trigger))
    ingest.ingest_stream(stream, *where, processed_at=NOW, **options).awaitTermination()
    return catalog_store.read_segments(spark, where[0])


def test_ingest_over_two_runs(spark, tmp_path):
    where = roots(spark, tmp_path)
    feed(tmp_path, {"a.jpg": b"1", "sub/a.jpg": b"2", "b.jpg": b"1"})
    first = run(spark, tmp_path, where)
    assert column(first, "target_path") == ["/lib/2024/06/01/a.jpg", "/lib/2024/06/01/a_1.jpg"]
    feed(tmp_path, {"new/a.jpg": b"3", "new/copy.JPG": b"2", "c.txt": b"4"})
    second = run(spark, tmp_path, where)
    assert column(second, "target_path") == [f"/lib/2024/06/01/{n}.jpg" for n in ("a", "a_1", "a_2")]
    assert column(second, "id") == [1, 2, 3]
    plans = spark.read.parquet(where[1])
    assert sorted((r.action, r.name) for r in plans.collect()) == [
        ("DELETE_DUPLICATE", "b.jpg"), ("MOVE", "a.jpg"), ("MOVE", "a.jpg"), ("MOVE", "a.jpg"), ("SKIP_DUPLICATE", "copy.JPG"),
    ]


def test_small_batches_give_one_record_per_content(spark, tmp_path):
    where = roots(spark, tmp_path)
    feed(tmp_path, {f"{i}.jpg": str(i % 3).encode() for i in range(6)})
    found = run(spark, tmp_path, where, per_trigger=2)
    assert found.count() == found.select("hash").distinct().count() == 3


def test_replayed_batch_changes_nothing(spark, tmp_path):
    where = roots(spark, tmp_path, records(spark, [(1, "old", "/s/o.jpg", "/lib/o.jpg")]))
    batch = inventory(spark, [("/s/a.jpg", "a"), ("/s/b.jpg", "a"), ("/s/c.jpg", "old")])
    for _ in range(2):
        ingest.ingest_batch(batch, 0, *where[:3], processed_at=NOW)
    assert sorted((r.id, r.hash) for r in catalog_store.read_segments(spark, where[0]).collect()) == [(1, "old"), (2, "a")]
    assert spark.read.parquet(where[1]).count() == 3


def test_a_vanished_original_is_replaced_in_the_stream(spark, tmp_path):
    """Each batch sees the files that exist then; segments are folded as the batches come."""
    where = roots(spark, tmp_path, records(spark, [(1, "a", "/s/a.jpg", "/lib/a.jpg"), (2, "b", "/s/b.jpg", "/lib/b.jpg")]))
    present = ["/lib/b.jpg"]

    def live():
        return spark.createDataFrame([(p,) for p in present], "path string")

    batches = [[("/s/a2.jpg", "a"), ("/s/b2.jpg", "b")], [("/s/a3.jpg", "a")], [("/s/c.jpg", "c")], [("/s/b3.jpg", "b")]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            ingest.ingest_batch(inventory(spark, rows), number, *where[:3], processed_at=NOW, live=live, fan=2)
        present.append("/lib/2024/06/01/a2.jpg")
        if number == 2:
            present.remove("/lib/b.jpg")
    plans = spark.read.parquet(where[1])
    assert sorted((r.name, r.action) for r in plans.collect()) == [
        ("a2.jpg", "REPLACE_STALE"), ("a3.jpg", "DELETE_DUPLICATE"), ("b2.jpg", "DELETE_DUPLICATE"), ("b3.jpg", "REPLACE_STALE"), ("c.jpg", "MOVE"),
    ]
    found = catalog_store.read_segments(spark, where[0])
    assert sorted((r.hash, r.id, r.target_path) for r in found.collect()) == [
        ("a", 3, "/lib/2024/06/01/a2.jpg"), ("b", 5, "/lib/2024/06/01/b3.jpg"), ("c", 4, "/lib/2024/06/01/c.jpg"),
    ]
    assert [(p.low, p.high) for p in catalog_store.catalog_parts(spark, where[0])] == [(-1, 2), (3, 3)]


def test_replays_keep_the_time_of_the_first_try(spark, tmp_path):
    where = roots(spark, tmp_path)
    time = ingest.batch_time(spark, where[0], 4)
    assert ingest.batch_time(spark, where[0], 4) == time
    ingest.ingest_batch(inventory(spark, [("/s/a.jpg", "a")]), 4, *where[:3])
    record = catalog_store.read_segments(spark, where[0]).first()
    assert str(record.processed_at)[:19] == time and record.target_path == f"/lib/{time[:10].replace('-', '/')}/a.jpg"


def test_ids_go_on_over_empty_batches(spark, tmp_path):
    where = roots(spark, tmp_path, records(spark, [(7, "old", "/s/o.jpg", "/lib/o.jpg")]))
    for batch, rows in enumerate(([("/s/o.jpg", "old")], [], [("/s/a.jpg", "a")])):
        ingest.ingest_batch(inventory(spark, rows), batch, *where[:3], processed_at=NOW)
    assert column(catalog_store.read_segments(spark, where[0]), "id") == [7, 8]


def test_all_bursts_of_a_table(spark):
    rows = [("/a.jpg", "CREATE", 0.0), ("/a.jpg", "WRITE", 2.0), ("/a.jpg", "WRITE", 4.1), ("/b.jpg", "REMOVE", 9.0)]
    table = spark.createDataFrame([(p, op, T0 + dt.timedelta(seconds=s)) for p, op, s in rows], FILE_EVENTS)
    assert sorted((r.path, r.events) for r in events.debounce_events(table).collect()) == [("/a.jpg", 1), ("/a.jpg", 2), ("/b.jpg", 1)]


def test_names_below_a_folder_are_pushed_down(spark, tmp_path):
    where = roots(spark, tmp_path, records(spark, [(1, "a", "/s/x.jpg", "/lib/x.jpg"), (2, "b", "/lib/y.jpg", ""), (3, "c", "/s/z", "/libs/z"), (4, "d", "/s/z", "/lib/in/z")]))
    found = catalog_index.names_below(spark, where[0], "/lib")
    assert column(found, "name") == ["x.jpg", "y.jpg", "z"]
    assert "StringStartsWith(target_dir,/lib/)" in found._jdf.queryExecution().executedPlan().toString()
    old = names_in_use(catalog_store.read_segments(spark, where[0]), "/lib")
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, found.collect()))


def test_stream_ends_like_the_batch_job(spark, tmp_path):
    where = roots(spark, tmp_path)
    feed(tmp_path, {f"{i}/{i % 4}.jpg": str(i % 7).encode() for i in range(20)})
    found = run(spark, tmp_path, where)
    folder = files.file_inventory(spark, str(tmp_path / "in"), ["jpg"])
    assert column(found, "hash") == column(dedup_keep_first(folder), "hash")
    assert column(found, "source_path") == column(dedup_keep_first(folder), "path")


@pytest.mark.parametrize("start", [ingest.scheduled_ingest, ingest.micro_batch_flush])
def test_interval_triggers(spark, tmp_path, start):
    where = roots(spark, tmp_path)
    feed(tmp_path, {"a.jpg": b"1"})
    stream = files.hashed(files.new_file_stream(spark, str(tmp_path / "in"), ["jpg"], ingest.FLUSH_FILES))
    query = start(stream, *where, interval="1 second", processed_at=NOW)
    try:
        query.processAllAvailable()
        feed(tmp_path, {"late.jpg": b"2"})
        query.processAllAvailable()
    finally:
        query.stop()
    assert column(catalog_store.read_segments(spark, where[0]), "original_name") == ["a.jpg", "late.jpg"]


def test_running_totals(spark, tmp_path):
    plans, root = str(tmp_path / "plans"), str(tmp_path / "totals")
    schema = "action string, file_size bigint"
    spark.createDataFrame([("MOVE", 5), ("MOVE", 7), ("ERROR", 1)], schema).write.parquet(plans)

    def totals():
        stream = spark.readStream.schema(schema).parquet(plans)
        progress.start_totals(stream, root, str(tmp_path / "checkpoint"), interval=None).awaitTermination()
        return {r.action: (r.files, r.bytes) for r in progress.latest_totals(spark, root).collect()}

    assert totals() == {"MOVE": (2, 12), "ERROR": (1, 1)}
    spark.createDataFrame([("MOVE", 3), ("SKIP_DUPLICATE", None)], schema).write.mode("append").parquet(plans)
    assert totals() == {"MOVE": (3, 15), "ERROR": (1, 1), "SKIP_DUPLICATE": (1, 0)}


def test_rates_of_running_totals(spark):
    rows = [("MOVE", 10, "2024-01-01 00:00:00"), ("MOVE", 30, "2024-01-01 00:00:08.5"), ("MOVE", None, None), ("ERROR", 1, "2024-01-01 00:00:03")]
    plans = spark.createDataFrame(rows, "action string, file_size bigint, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    found = {r.action: r for r in progress.running_totals(plans.unionByName(plans.limit(0)), "at").collect()}
    moved, failed = found["MOVE"], found["ERROR"]
    assert (moved.files, moved.bytes, moved.elapsed_seconds) == (3, 40, 8.5)
    assert (moved.files_per_second, moved.bytes_per_second) == (3 / 8.5, 40 / 8.5)
    assert (failed.elapsed_seconds, failed.files_per_second, failed.bytes_per_second) == (0.0, None, None)


def test_names_of_catalogued_files(spark):
    store = records(spark, [(1, "a", "/s/x.jpg", "/lib/2024/a b.jpg"), (2, "b", "/s/y.jpg", "")])
    found = names_in_use(store).orderBy(F.col("name")).collect()
    assert [tuple(r) for r in found] == [("/lib/2024", "a b.jpg"), ("/s", "y.jpg")]


def test_a_part_is_read_alone(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "concat('/', id) as path")
    table = registry.dealt(rows, F.col("id") % 4)
    assert table.columns == ["id", "path", "part"] and table.count() == 100
    one = table.where("part = 3")
    assert column(one, "id") == list(range(3, 100, 4))
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
