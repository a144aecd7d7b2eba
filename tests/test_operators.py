import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import catalog as cat
from tallyshelf.operators import dedup, filters, matching, naming, stats
from tallyshelf.schemas import CATALOG

T0 = dt.datetime(2024, 1, 1)


def inventory(spark, rows):
    """Inventory from (path, hash) or (path, hash, size)."""
    full = [(p, p.split("/")[-1], h, *(rest or [10])) for p, h, *rest in rows]
    return spark.createDataFrame(full, "path string, name string, hash string, file_size bigint").select(
        "path", "name", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("extension"), "file_size",
        F.lit(T0).cast("timestamp_ntz").alias("modified_at"), "hash", F.lit("sha256").alias("hash_type"),
    )


def records(spark, rows):
    """Catalog from (id, hash, source, target)."""
    full = [(i, h, s.split("/")[-1], 10, ".jpg", T0, T0, s, t, "sha256") for i, h, s, t in rows]
    return spark.createDataFrame(full, CATALOG)


def column(df, name):
    return sorted(r[name] for r in df.select(name).collect())


def test_filters(spark):
    names = [
        "a.jpg", "b.JPG", "c.txt", ".d.jpg", "~e.jpg", "f.tmp", "g.part1.jpg", "h.temp", "F.TMP", "x.tar.gz", ".bashrc",
        "none", "i.cr2", "j.tif",
    ]
    files = inventory(spark, [(f"/s/{n}", n) for n in names])
    assert column(filters.filter_supported(files), "name") == [".d.jpg", "a.jpg", "b.JPG", "g.part1.jpg", "~e.jpg"]
    assert column(filters.filter_supported(files, ["TXT", ".gz"]), "name") == ["c.txt", "x.tar.gz"]
    assert column(filters.filter_supported(files, []), "name") == column(filters.filter_supported(files), "name")
    assert {"i.cr2", "j.tif", "b.JPG"} <= set(column(filters.filter_images(files), "name"))
    assert {".d.jpg", ".bashrc"} == set(names) - set(column(filters.filter_hidden(files), "name"))
    assert {"~e.jpg", "f.tmp", "g.part1.jpg", "h.temp"} == set(names) - set(column(filters.filter_temp(files), "name"))


def test_size_filters(spark):
    files = inventory(spark, [("/a", "1", 0), ("/b", "2", 5), ("/c", "3", 6)])
    assert column(filters.filter_max_size(files, 5), "path") == ["/a", "/b"]
    assert column(filters.filter_max_size(files, 0), "path") == ["/a"]
    assert column(filters.filter_max_size(files), "path") == ["/a", "/b", "/c"]
    assert column(filters.filter_ready(files), "path") == ["/b", "/c"]
    assert column(filters.filter_ready(files, 5), "path") == ["/b"]


def test_filters_reach_the_scan(spark, tmp_path):
    records(spark, [(1, "h", "/s", "/t")]).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = filters.large_files(stored).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(file_size,1048576)" in plan and "ReadSchema: struct<id:bigint,file_size:bigint>" in plan
    plan = filters.file_by_hash(stored, "h")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hash,h)" in plan


def test_existing_path_falls_back(spark):
    found = cat.existing_path(records(spark, [(1, "a", "/s/1", "/t/1"), (2, "b", "/s/2", ""), (3, "c", "/s/3", None)]))
    assert column(found, "existing_path") == ["/s/2", "/s/3", "/t/1"]


def test_catalog_rows_follow_the_mode(spark):
    files = inventory(spark, [("/s/A.JPG", "h")]).withColumn("target_path", F.lit("/t/A.JPG"))
    ingest = cat.to_catalog_rows(files, "ingest", "2024-06-01 00:00:00").first()
    assert (ingest.created_at, ingest.target_path, ingest.extension) == (dt.datetime(2024, 6, 1), "/t/A.JPG", ".jpg")
    scan = cat.to_catalog_rows(files, "scan", "2024-06-01 00:00:00").first()
    assert (scan.created_at, scan.target_path, scan.original_name) == (T0, "/s/A.JPG", "A.JPG")
    assert cat.to_catalog_rows(files.withColumn("hash_type", F.lit("md5")), "scan").first().hash_type == "md5"
    with pytest.raises(ValueError):
        cat.to_catalog_rows(files, "watch")


def test_catalog_columns_hold_current_time_without_zone(spark):
    row = cat.to_catalog_rows(inventory(spark, [("/s/A.JPG", "h")]), "scan").first()
    assert abs((row.processed_at - dt.datetime.now(dt.UTC).replace(tzinfo=None)).total_seconds()) < 60


def test_ids_are_dense_unique_and_follow_the_catalog(spark):
    rng = random.Random(1)
    hashes = [f"{rng.getrandbits(256):064x}" for _ in range(500)]
    rows = records(spark, [(0, h, "/s", "/t") for h in hashes]).drop("id")
    ids = {r.hash: r.id for r in cat.assign_ids(rows, records(spark, [(41, "x", "/s", "/t")])).collect()}
    assert [ids[h] for h in sorted(hashes)] == list(range(42, 542))
    assert column(cat.assign_ids(rows), "id") == list(range(1, 501))


def test_delete_and_replace(spark):
    old = records(spark, [(1, "a", "/s/1", "/t/1"), (2, "b", "/s/2", "/t/2")])
    gone = spark.createDataFrame([("b",), ("z",), ("b",)], "hash string")
    assert column(cat.delete_records(old, gone), "hash") == ["a"]
    report = {r.hash: (r.rows_affected, r.warning) for r in cat.deletion_report(old, gone).collect()}
    assert report == {"b": (1, None), "z": (0, "no such record")}
    new = records(spark, [(3, "b", "/s/3", "/t/3")])
    assert column(cat.replace_stale(old, new), "id") == [1, 3]


def test_check_catalog_counts_violations(spark):
    rows = [
        (1, "a", "n", 1, ".jpg", T0, T0, "/s", None, "sha256"),
        (2, "a", None, 1, "." + "x" * 50, T0, None, "/s", None, "sha256"),
        (3, None, "n" * 501, None, ".jpg", T0, T0, "/s", None, "s" * 21),
        (4, None, "n", 1, ".jpg", T0, T0, "/s", None, "sha256"),
    ]
    loose = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATALOG.fields))
    found = {r.check: r.violations for r in cat.check_catalog(loose).collect()}
    bad = {name: n for name, n in found.items() if n}
    assert bad == {
        "unique_hash": 1, "not_null_hash": 2, "not_null_original_name": 1, "not_null_file_size": 1,
        "max_length_original_name": 1, "max_length_extension": 1, "max_length_hash_type": 1,
    }


def test_keep_first_keep_last(spark):
    files = inventory(spark, [("/s/a-c", "h"), ("/s/a/b", "h"), ("/s/z", "i")])
    assert column(dedup.dedup_keep_first(files), "path") == ["/s/a/b", "/s/z"]
    old = records(spark, [(1, "a", "/1", ""), (5, "a", "/5", ""), (3, "a", "/3", ""), (2, "b", "/2", "")])
    assert column(dedup.dedup_keep_last(old), "id") == [2, 5]
    assert column(cat.compact_catalog(old), "id") == [2, 5]


def test_keep_first_limits_groups_before_the_shuffle(spark):
    plan = dedup.dedup_keep_first(inventory(spark, [("/a", "h")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def skewed(spark, n=600):
    """A third of all rows share one hash, a sixth another."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        h = "hot" if i % 3 == 0 else "warm" if i % 6 == 1 else f"h{rng.randrange(80)}"
        rows.append((f"/s/{rng.randrange(9)}/{i}.jpg", h))
    return rows


def test_duplicate_groups_match_brute_force(spark):
    rows = skewed(spark)
    groups = {}
    for path, h in rows:
        groups.setdefault(h, []).append(path)
    unread = [("/s/x.jpg", None), ("/s/y.jpg", None)]
    found = dedup.duplicate_groups(inventory(spark, rows + unread)).collect()
    assert len(found) == len(rows) + 2
    assert all((r.kept_path, r.copies, r.is_duplicate) == (r.path, 1, False) for r in found if r.hash is None)
    for r in (r for r in found if r.hash is not None):
        kept = min(groups[r.hash], key=lambda p: p.split("/"))
        assert (r.kept_path, r.copies, r.is_duplicate) == (kept, len(groups[r.hash]), r.path != kept)


def test_files_without_hash_are_no_copies(spark):
    files = inventory(spark, [("/s/a", None), ("/s/b", None), ("/s/c", "h"), ("/s/d", "h")])
    assert column(dedup.dedup_keep_first(files), "path") == ["/s/a", "/s/b", "/s/c"]


def test_matching_survives_hot_hashes(spark):
    rows = skewed(spark)
    known = {"hot", "h1", "h2", "h3"}
    store = records(spark, [(i, h, f"/src/{h}", f"/lib/{h}") for i, h in enumerate(sorted(known))])
    files = inventory(spark, rows)
    semi = column(matching.known_files(files, store), "path")
    anti = column(matching.new_files(files, store), "path")
    assert semi == sorted(p for p, h in rows if h in known)
    assert anti == sorted(p for p, h in rows if h not in known)
    joined = matching.match_catalog(files, store).collect()
    assert len(joined) == len(rows)
    assert all(r.known == (r.hash in known) and r.existing_path == (f"/lib/{r.hash}" if r.known else None) for r in joined)


def test_stale_and_vanished(spark):
    store = records(spark, [(1, "a", "/s/1", "/t/1"), (2, "b", "/s/2", ""), (3, "c", "/s/3", "/t/3")])
    live = spark.createDataFrame([("/t/1",), ("/s/2",)], "path string")
    assert column(matching.stale_records(store, live), "id") == [3]
    assert column(matching.drop_vanished(inventory(spark, [("/t/1", "a"), ("/x", "b")]), live), "path") == ["/t/1"]


def test_taken_and_free_names(spark):
    wanted = spark.createDataFrame([("/t", "a"), ("/t", "b"), ("/u", "a")], "target_dir string, name string")
    used = spark.createDataFrame([("/t", "a"), ("/t", "c")], "target_dir string, name string")
    assert [tuple(r) for r in matching.taken_names(wanted, used).collect()] == [("/t", "a")]
    assert sorted(tuple(r) for r in matching.free_names(wanted, used).collect()) == [("/t", "b"), ("/u", "a")]


def split_name(name):
    at = name.rfind(".")
    return (name, "") if at < 0 else (name[:at], name[at:])


def brute_force_names(wanted, taken):
    """Names by walking: own name for the first if free; the others, by digest, the next suffix nobody has or brings along."""
    brought = {(d, n) for _, d, n in wanted}
    used, result, queues = set(taken), {}, {}
    for path, d, n in sorted(wanted, key=lambda w: w[0].split("/")):
        queues.setdefault((d, n), []).append(path)
    for (d, n), paths in queues.items():
        stem, ext = split_name(n)
        waiting = list(paths)
        if (d, n) not in used:
            result[waiting.pop(0)] = n
        suffix = 0
        for path in sorted(waiting, key=lambda p: hashlib.md5(p.encode()).hexdigest()):
            suffix += 1
            while (d, f"{stem}_{suffix}{ext}") in used or (d, f"{stem}_{suffix}{ext}") in brought:
                suffix += 1
            result[path] = f"{stem}_{suffix}{ext}"
    return result


@pytest.mark.parametrize("seed", range(4))
def test_names_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "b", "b_3", ".rc", "_1.rc", "x.tar.gz", "a_01.jpg", "a_1000.jpg", "A.jpg"]
    wanted = [(f"/s/{rng.randrange(5)}/{i}/{n}", rng.choice(["/t", "/u"]), n) for i, n in enumerate(rng.choices(pool, k=120))]
    taken = {(rng.choice(["/t", "/u"]), rng.choice(pool)) for _ in range(8)}
    files = spark.createDataFrame(wanted, "path string, target_dir string, name string")
    found = naming.resolve_name_conflicts(files, spark.createDataFrame(sorted(taken), "target_dir string, name string"))
    rows = found.collect()
    assert {r.path: r.final_name for r in rows} == brute_force_names(wanted, taken)
    finals = [(r.target_dir, r.final_name) for r in rows]
    assert len(set(finals)) == len(finals) and not set(finals) & taken


def test_names_have_no_end(spark, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", 100)
    wanted = [(f"/s/{i:04d}/a.jpg", "/t", "a.jpg") for i in range(1502)]
    taken = {("/t", "a.jpg"), ("/t", "a_999.jpg"), ("/t", "a_5.jpg"), ("/t", "a_100000.jpg"), ("/other", "a_7.jpg")}
    files = spark.createDataFrame(wanted, "path string, target_dir string, name string")
    names = naming.resolve_name_conflicts(files, spark.createDataFrame(sorted(taken), "target_dir string, name string"))
    assert {r.path: r.final_name for r in names.collect()} == brute_force_names(wanted, taken)
    limited = naming.resolve_name_conflicts(files, max_suffix=999)
    assert limited.where("final_name is null").count() == 1502 - 1000


def test_names_without_case(spark):
    wanted = [("/s/1/A.jpg", "/t", "A.jpg"), ("/s/2/a.jpg", "/t", "a.jpg"), ("/s/3/a_1.JPG", "/t", "a_1.JPG")]
    files = spark.createDataFrame(wanted, "path string, target_dir string, name string")
    names = {r.path: r.final_name for r in naming.resolve_name_conflicts(files, ignore_case=True).collect()}
    assert names == {"/s/1/A.jpg": "A.jpg", "/s/2/a.jpg": "a_2.jpg", "/s/3/a_1.JPG": "a_1.JPG"}


def test_statistics_of_nothing(spark):
    empty = records(spark, [])
    assert stats.total_size(empty).first()[0] == 0 and stats.total_files(empty).first()[0] == 0
    assert [(r.total, r["count"], r["size"]) for r in stats.catalog_statistics(empty).collect()] in ([], [(True, 0, 0)])


def test_catalog_statistics(spark):
    files = inventory(spark, [("/a.jpg", "1", 5), ("/b.jpg", "2", 7), ("/c.png", "3", None)])
    found = {(r.extension, r.total): (r["count"], r["size"]) for r in stats.catalog_statistics(files).collect()}
    assert found == {(None, True): (3, 12), (".jpg", False): (2, 12), (".png", False): (1, 0)}
    assert [r.extension for r in stats.extensions_ranked(files).collect()] == [".jpg", ".png"]


def test_size_tiers_take_their_bounds(spark):
    mb = 1 << 20
    sizes = [0, mb - 1, mb, 10 * mb, 10 * mb + 1]
    files = inventory(spark, [(f"/{i}", str(i), s) for i, s in enumerate(sizes)])
    tiers = {r.tier: r["count"] for r in stats.stats_by_size_tier(files).collect()}
    assert tiers == {"small": 2, "medium": 2, "large": 1}


def plan_rows(spark, rows):
    return spark.createDataFrame(rows, "action string, file_size bigint")


def test_processing_statistics(spark):
    plan = plan_rows(spark, [("MOVE", 10), ("REPLACE_STALE", 20), ("DELETE_DUPLICATE", 5), ("ERROR", 100)])
    assert stats.processing_stats(plan).first().asDict() == {
        "processed_files": 4, "moved_files": 2, "deleted_files": 1, "skipped_files": 0, "error_count": 1,
        "total_size": 35, "moved_size": 30,
    }
    assert stats.average_size(plan).first().asDict() == {"avg_size_reported": 17, "avg_size_moved": 15}
    assert tuple(stats.outcome_percentages(plan).first()) == (50.0, 25.0, 25.0)
    empty = plan_rows(spark, [])
    assert tuple(stats.outcome_percentages(empty).first()) == (None, None, None)
    assert tuple(stats.average_size(empty).first()) == (None, None)


def test_scan_statistics_add_up(spark):
    actions = ["CATALOG"] * 4 + ["SKIP_DUPLICATE"] * 2 + ["ALREADY_CATALOGUED", "DELETE_DUPLICATE", "ERROR"]
    found = stats.scan_stats(plan_rows(spark, [(a, 1) for a in actions])).first().asDict()
    assert found == {"processed": 4, "skipped": 3, "errors": 1, "deleted": 1, "total": 9}


def test_throughput_guards_zero_time(spark):
    one = spark.createDataFrame([(T0, 5)], "ts timestamp, file_size bigint")
    assert stats.throughput(one).first().files_per_second is None
    two = spark.createDataFrame([(T0, 5), (T0 + dt.timedelta(seconds=4), 3)], "ts timestamp, file_size bigint")
    found = stats.throughput(two).first()
    assert (found.files_per_second, found.bytes_per_second, found.seconds) == (0.5, 2.0, 4.0)


def test_worker_load(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "worker_id bigint, load_ns bigint")
    assert tuple(stats.worker_load(rows).first()) == (2, 35, 17, 5, 30, 11)


def test_top_lists(spark):
    store = records(spark, [(i, str(i), f"/s/{i}", "") for i in range(5)]).withColumn("file_size", F.col("id") % 3)
    assert [r.id for r in cat.largest_files(store, 3).collect()] == [2, 1, 4]
    assert [r.id for r in cat.files_by_extension(store, ".jpg", 2).collect()] == [0, 1]
    assert cat.largest_files(store, 2, per_extension=True).count() == 2
