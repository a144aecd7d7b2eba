import random
from collections import Counter

from pyspark.sql import functions as F

from tallyshelf.operators.catalog import names_in_use
from tallyshelf.plans import apply_plan, compact_catalog, ingest_folder, plan_ingest, plan_scan
from tallyshelf.plans.catalogs import new_records
from tallyshelf.session import settle

from .test_operators import column, inventory, records

NOW = "2024-06-01 12:00:00"
DAY = "/lib/2024/06/01"


def paths(spark, found):
    return spark.createDataFrame([(p,) for p in found], "path string")


def actions(plan):
    return {r.path: (r.action, r.existing_path, r.target_path) for r in plan.collect()}


def test_ingest_actions(spark):
    files = inventory(
        spark,
        [
            ("/s/new.jpg", "new"), ("/s/z/new.jpg", "new"), ("/s/known.jpg", "known"), ("/s/lost.jpg", "lost"),
            ("/s/lost2.jpg", "lost"), ("/s/n/new.jpg", "other"), ("/s/skip.txt", "txt"), ("/s/big.jpg", "big", 11),
            ("/lib/self.jpg", "self"),
        ],
    )
    store = records(
        spark,
        [(1, "known", "/s/k", "/lib/known.jpg"), (2, "lost", "/s/l", "/lib/lost.jpg"), (3, "self", "/lib/self.jpg", "")],
    )
    plan = plan_ingest(files, store, "/lib/", NOW, max_size=10, live_paths=paths(spark, ["/lib/known.jpg"]))
    assert actions(plan) == {
        "/s/n/new.jpg": ("MOVE", None, f"{DAY}/new.jpg"),
        "/s/new.jpg": ("MOVE", None, f"{DAY}/new_1.jpg"),
        "/s/z/new.jpg": ("DELETE_DUPLICATE", f"{DAY}/new_1.jpg", None),
        "/s/known.jpg": ("DELETE_DUPLICATE", "/lib/known.jpg", None),
        "/s/lost.jpg": ("REPLACE_STALE", "/lib/lost.jpg", f"{DAY}/lost.jpg"),
        "/s/lost2.jpg": ("DELETE_DUPLICATE", f"{DAY}/lost.jpg", None),
        "/lib/self.jpg": ("ALREADY_CATALOGUED", "/lib/self.jpg", None),
        "/s/skip.txt": ("SKIPPED", None, None),
        "/s/big.jpg": ("SKIPPED", None, None),
    }
    assert {r.path: r.reason for r in plan.where("reason is not null").collect()} == {"/s/skip.txt": "extension", "/s/big.jpg": "size"}


def test_without_a_live_inventory_nothing_is_stale_or_deleted(spark):
    files, store = inventory(spark, [("/s/a.jpg", "h")]), records(spark, [(1, "h", "/s/x", "/lib/x.jpg")])
    assert actions(plan_ingest(files, store, "/lib", NOW)) == {"/s/a.jpg": ("SKIP_DUPLICATE", "/lib/x.jpg", None)}
    scan = plan_scan(files, store, remove_duplicates=True)
    assert actions(scan) == {"/s/a.jpg": ("SKIP_DUPLICATE", "/lib/x.jpg", None)}


def test_optional_filters(spark):
    files = inventory(spark, [("/s/.a.jpg", "1"), ("/s/~b.jpg", "2"), ("/s/c.jpg", "3", 0), ("/s/d.jpg", "4")])
    none = records(spark, [])
    assert plan_ingest(files, none, "/lib", NOW).count() == 4
    found = plan_ingest(files, none, "/lib", NOW, skip_hidden=True, skip_temp=True, only_ready=True)
    assert {r.path: r.reason for r in found.collect()} == {
        "/s/.a.jpg": "hidden", "/s/~b.jpg": "temporary", "/s/c.jpg": "empty", "/s/d.jpg": None,
    }


def test_a_plan_is_lazy(spark):
    files, store = settle(inventory(spark, [("/s/a.jpg", "1")]), "files"), settle(records(spark, []), "catalog")
    jobs = spark.sparkContext.statusTracker()
    before = set(jobs.getJobIdsForGroup(None))
    plan_ingest(files, store, "/lib", NOW, live_paths=files.select("path"))
    plan_scan(files, store, True)
    assert set(jobs.getJobIdsForGroup(None)) == before


def test_large_files_are_planned(spark):
    files = inventory(spark, [("/s/a.jpg", "1", 200 << 20), ("/s/b.jpg", "2", 101 << 20)])
    assert {a for a, _, _ in actions(plan_ingest(files, records(spark, []), "/lib", NOW)).values()} == {"MOVE"}


def test_a_folder_in_one_call(spark, tmp_path):
    for name, content in {"a.jpg": b"1", "b.jpg": b"1", "c.txt": b"2"}.items():
        (tmp_path / name).write_bytes(content)
    plan = ingest_folder(spark, str(tmp_path), records(spark, []), "/lib", processed_at=NOW)
    assert sorted((r.name, r.action) for r in plan.collect()) == [("a.jpg", "MOVE"), ("b.jpg", "DELETE_DUPLICATE"), ("c.txt", "SKIPPED")]


def test_files_can_be_dated_by_a_column(spark):
    plan = plan_ingest(inventory(spark, [("/s/a.jpg", "1")]), records(spark, []), "/lib", NOW, date_col="modified_at")
    assert plan.first().target_path == "/lib/2024/01/01/a.jpg"


def test_copies_of_a_file_without_name_are_kept(spark):
    rows = [(f"/s/{i:04d}/a.jpg", f"h{i}") for i in range(1001)] + [("/z/copy.jpg", "h1000")]
    files = inventory(spark, rows)
    found = actions(plan_ingest(files, records(spark, []), "/lib", NOW))
    assert Counter(a for a, _, _ in found.values()) == {"MOVE": 1001, "DELETE_DUPLICATE": 1}
    last = next(h for p, h in rows if found[p][2] == f"{DAY}/a_1000.jpg")
    copies = inventory(spark, rows + [("/z/other.jpg", last)])
    limited = plan_ingest(copies, records(spark, []), "/lib", NOW, max_suffix=999)
    lost = limited.where("action = 'ERROR'").collect()
    assert {r.hash for r in lost} == {last} and {r.path for r in lost} > {"/z/other.jpg"}
    assert {r.reason for r in lost} == {"no name left"}


def test_names_of_the_catalog_or_of_live_files_are_avoided(spark):
    files = inventory(spark, [("/s/a.jpg", "1"), ("/s/b.jpg", "2")])
    store = records(spark, [(1, "x", "/o", f"{DAY}/a.jpg"), (2, "y", "/o", f"{DAY}/b.jpg")])
    found = actions(plan_ingest(files, store, "/lib", NOW))
    assert sorted(t for _, _, t in found.values()) == [f"{DAY}/a_1.jpg", f"{DAY}/b_1.jpg"]
    found = actions(plan_ingest(files, store, "/lib", NOW, live_paths=paths(spark, [f"{DAY}/a.jpg"])))
    assert found["/s/a.jpg"][2] == f"{DAY}/a_1.jpg" and found["/s/b.jpg"][2] == f"{DAY}/b.jpg"


def test_files_without_hash_are_errors(spark):
    files = inventory(spark, [("/s/a.jpg", None), ("/s/b.jpg", None), ("/s/c.jpg", "c")])
    none = records(spark, [])
    for plan in (plan_ingest(files, none, "/lib", NOW), plan_scan(files, none, True)):
        found = {p: a for p, (a, _, _) in actions(plan).items()}
        assert found["/s/a.jpg"] == found["/s/b.jpg"] == "ERROR" and found["/s/c.jpg"] in ("MOVE", "CATALOG")


def test_scan_actions(spark):
    files = inventory(
        spark,
        [("/p/a.jpg", "a"), ("/p/a2.jpg", "a"), ("/p/b.jpg", "b"), ("/p/c.jpg", "c"), ("/p/d.txt", "d"), ("/p/e.jpg", "e")],
    )
    store = records(spark, [(1, "b", "/p/b.jpg", "/p/b.jpg"), (2, "c", "/old/c.jpg", "/old/c.jpg"), (3, "e", "/x/e", "/x/e.jpg")])
    live = paths(spark, ["/x/e.jpg"])
    wanted = {
        "/p/a.jpg": ("CATALOG", None, "/p/a.jpg"),
        "/p/a2.jpg": ("SKIP_DUPLICATE", "/p/a.jpg", None),
        "/p/b.jpg": ("ALREADY_CATALOGUED", "/p/b.jpg", None),
        "/p/c.jpg": ("REPLACE_STALE", "/old/c.jpg", "/p/c.jpg"),
        "/p/e.jpg": ("SKIP_DUPLICATE", "/x/e.jpg", None),
        "/p/d.txt": ("SKIPPED", None, None),
    }
    assert actions(plan_scan(files, store, live_paths=live)) == wanted
    removing = {p: ("DELETE_DUPLICATE" if a == "SKIP_DUPLICATE" else a, e, t) for p, (a, e, t) in wanted.items()}
    assert actions(plan_scan(files, store, remove_duplicates=True, live_paths=live)) == removing


def test_second_scan_changes_nothing(spark):
    files, store = inventory(spark, [("/p/a.jpg", "a"), ("/p/b.jpg", "b")]), records(spark, [])
    plan = settle(plan_scan(files, store, remove_duplicates=True), "plan")
    after = settle(apply_plan(plan, store, "scan", NOW), "catalog")
    again = plan_scan(files, after, remove_duplicates=True, live_paths=files.select("path"))
    assert {r.action for r in again.collect()} == {"ALREADY_CATALOGUED"}


def busy_folder(seed, n=500):
    """A third of the files are copies of one content, and many share a name."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h = "blank" if i % 3 == 0 else f"h{rng.randrange(200)}"
        rows.append((f"/s/{rng.randrange(6)}/{i}/{rng.choice(['a', 'b', 'a_1'])}.jpg", h))
    return rows


def test_plan_invariants(spark):
    rows = busy_folder(5)
    files = settle(inventory(spark, rows), "files")
    store = records(spark, [(1, "h1", "/s/x", "/lib/x.jpg"), (2, "h2", "/s/y", "/lib/y.jpg"), (3, "blank", "/b", "/lib/gone.jpg")])
    live = paths(spark, ["/lib/x.jpg", "/lib/y.jpg"])
    plan = settle(plan_ingest(files, store, "/lib", NOW, live_paths=live), "plan")
    found = plan.collect()
    assert Counter(r.path for r in found) == Counter(p for p, _ in rows)
    kept = [r for r in found if r.action in ("MOVE", "REPLACE_STALE")]
    assert max(Counter(r.hash for r in kept).values()) == 1
    assert {r.hash for r in kept} == {h for _, h in rows} - {"h1", "h2"}
    assert max(Counter(r.target_path for r in kept).values()) == 1
    targets = {r.hash: r.target_path for r in kept} | {"h1": "/lib/x.jpg", "h2": "/lib/y.jpg"}
    assert all(r.existing_path == targets[r.hash] for r in found if r.action == "DELETE_DUPLICATE")
    first = {}
    for p, h in rows:
        first[h] = min(first.get(h, p), p, key=lambda x: x.split("/"))
    assert all(r.path == first[r.hash] for r in kept)

    after = settle(apply_plan(plan, store, "ingest", NOW), "catalog")
    assert after.count() == after.select("hash").distinct().count() == len({h for _, h in rows} | {"h1", "h2"})
    assert after.count() == after.select("id").distinct().count()
    there = after.select(F.col("target_path").alias("path"))
    again = plan_ingest(files, after, "/lib", NOW, taken=names_in_use(after), live_paths=there)
    assert {r.action for r in again.collect()} == {"DELETE_DUPLICATE"}
    unsure = plan_ingest(files, after, "/lib", NOW)
    assert {r.action for r in unsure.collect()} == {"SKIP_DUPLICATE"}


def test_records_number_on_from_the_catalog(spark):
    plan = settle(plan_ingest(inventory(spark, [("/s/a.jpg", "b"), ("/s/b.jpg", "a")]), records(spark, []), "/lib", NOW), "plan")
    rows = new_records(plan, records(spark, [(7, "x", "/s", "/t")]), "ingest", NOW).orderBy("id").collect()
    assert [(r.id, r.hash, r.source_path) for r in rows] == [(8, "a", "/s/b.jpg"), (9, "b", "/s/a.jpg")]


def test_compaction_keeps_the_newest_record(spark):
    store = records(spark, [(1, "a", "/1", ""), (4, "a", "/4", ""), (2, "b", "/2", "")])
    assert column(compact_catalog(store), "id") == [2, 4]


def test_plans_have_no_cross_join(spark):
    files = settle(inventory(spark, busy_folder(2, 60)), "files")
    store = settle(records(spark, [(1, "h1", "/s/x", "/lib/x.jpg")]), "catalog")
    plan = plan_ingest(files, store, "/lib", NOW, taken=names_in_use(store))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert plan.where(F.col("action") == "ERROR").count() == 0
