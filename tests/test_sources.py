import hashlib

import pytest
from pyspark.sql import functions as F

from tallyshelf.session import scratch_path, settle, shared_dir
from tallyshelf.sources import catalog_store, files, logs, sinks
from tallyshelf.streaming.ingest import quarantine_failures

from .test_operators import column, inventory, records

NAMES = {
    "a.jpg": b"one", "b.JPG": b"one", "sub/a.jpg": b"two", "sub/deep/a_1.jpg": b"three", "c.txt": b"text", ".d.jpg": b"dot",
    "~e.jpg": b"tilde", "f.tmp": b"tmp", "g.part1.jpg": b"part", "_h.jpg": b"underscore", "i.png": b"", "big.png": b"x" * 100,
    "name with space.jpg": b"space", "ü.jpg": b"umlaut", "none": b"no extension", "x.tar.gz": b"archive",
}
UNSEEN = {".d.jpg", "_h.jpg", "i.png"}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, content in NAMES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root


def test_inventory(spark, tree):
    found = {r.path: r for r in files.file_inventory(spark, str(tree)).collect()}
    assert set(found) == {f"{tree}/{n}" for n in NAMES if n not in UNSEEN}
    row = found[f"{tree}/b.JPG"]
    assert (row.name, row.extension, row.file_size, row.hash_type) == ("b.JPG", ".jpg", 3, "sha256")
    assert all(r.hash == hashlib.sha256(NAMES[p[len(str(tree)) + 1 :]]).hexdigest() for p, r in found.items())
    assert {r.name for r in found.values()} >= {"name with space.jpg", "ü.jpg"}


def test_inventory_options(spark, tree):
    pictures = files.file_inventory(spark, str(tree), extensions=["jpg", ".PNG"], max_size=50, algorithm="md5")
    wanted = {n for n in NAMES if n.lower().endswith(".jpg") and n not in UNSEEN}
    assert {r.path[len(str(tree)) + 1 :] for r in pictures.collect()} == wanted
    assert pictures.where("name = 'b.JPG'").first().hash == hashlib.md5(b"one").hexdigest()


def test_listing_reads_no_content(spark, tree):
    plan = files.file_listing(spark, str(tree), max_size=50)._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan and "LessThanOrEqual(length,50)" in plan
    hashed = files.file_inventory(spark, str(tree), max_size=50)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in hashed and "Exchange" not in hashed


def test_unread_files_are_quarantined(spark, tree):
    listing = files.file_listing(spark, str(tree))
    found = quarantine_failures(listing, files.file_inventory(spark, str(tree), max_size=50)).collect()
    assert [(r.name, r.action, r.hash) for r in found] == [("big.png", "ERROR", None)]


def test_a_file_that_vanishes_while_hashing_is_quarantined(spark, tree):
    listing = settle(files.file_listing(spark, str(tree)), "listing")
    content = files.file_inventory(spark, str(tree))
    (tree / "c.txt").unlink()
    found = quarantine_failures(listing, content).collect()
    assert [(r.name, r.action) for r in found] == [("c.txt", "ERROR")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "catalog")
    catalog_store.write_snapshot(records(spark, [(1, "a", "/s", "/t")]), root, 1)
    catalog_store.write_snapshot(records(spark, [(1, "a", "/s", "/t"), (2, "b", "/s", None)]), root, 2)
    assert column(catalog_store.read_catalog(spark, root), "id") == [1, 2]
    assert column(catalog_store.read_catalog(spark, root, 1), "id") == [1]
    # A snapshot nobody announced is not seen, and does not stand in the way of the next writer.
    records(spark, [(9, "z", "/s", "/t")]).write.parquet(f"{root}/v=3")
    assert catalog_store.latest_version(spark, root) == 2
    catalog_store.write_snapshot(records(spark, [(3, "c", "/s", "/t")]), root, 3)
    assert column(catalog_store.read_catalog(spark, root), "id") == [3]
    with pytest.raises(ValueError, match="not newer"):
        catalog_store.write_snapshot(records(spark, []), root, 2)
    assert catalog_store.latest_version(spark, str(tmp_path / "none")) == -1


def test_segments(spark, tmp_path):
    root = str(tmp_path / "segments")
    catalog_store.init_segments(spark, root)
    assert catalog_store.read_segments(spark, root).count() == 0
    for batch in (0, 1, 1):
        catalog_store.append_catalog(records(spark, [(batch + 1, f"h{batch}", "/s", "/t")]), root, batch)
    assert column(catalog_store.read_segments(spark, root), "hash") == ["h0", "h1"]
    assert column(catalog_store.read_segments(spark, root, before=1), "hash") == ["h0"]
    plan = catalog_store.read_segments(spark, root, before=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan
    assert [catalog_store.last_id(spark, root, before) for before in (0, 1, 2)] == [0, 1, 2]


def test_log_text(spark, tmp_path):
    (tmp_path / "x.log").write_text("  [2025-01-01 00:00:00] INFO a:1 - ⏱️ x \n\nlast", encoding="utf-8")
    assert column(logs.read_log(spark, str(tmp_path)), "value") == ["", "[2025-01-01 00:00:00] INFO a:1 - ⏱️ x", "last"]


def test_plan_and_report_round_trip(spark, tmp_path):
    plan = inventory(spark, [("/s/a.jpg", "h")]).withColumn("action", F.lit("MOVE"))
    for _ in range(2):
        sinks.write_action_plan(plan, str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 1
    sinks.write_reports({"one": plan.select("path"), "two": plan.select("hash")}, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports/two")).first().hash == "h"


def test_library_holds_kept_files_by_date(spark, tmp_path, tree):
    content = files.read_files(spark, str(tree)).withColumn("path", files.plain_path("path"))
    plan = spark.createDataFrame(
        [(f"{tree}/a.jpg", "MOVE", "/lib/2024/06/01/a.jpg"), (f"{tree}/b.JPG", "DELETE_DUPLICATE", None), (f"{tree}/sub/a.jpg", "REPLACE_STALE", "/lib/2024/06/02/a_1.jpg")],
        "path string, action string, target_path string",
    )
    kept = sinks.with_content(plan, content)
    for _ in range(2):
        sinks.write_library(kept, str(tmp_path / "lib"), 3)
    assert (tmp_path / "lib/batch=3/year=2024/month=06/day=02").is_dir()
    stored = spark.read.parquet(str(tmp_path / "lib"))
    assert sorted((r.target_path, bytes(r.content)) for r in stored.collect()) == [
        ("/lib/2024/06/01/a.jpg", b"one"), ("/lib/2024/06/02/a_1.jpg", b"two"),
    ]


def test_no_size_is_too_large(spark, tmp_path):
    with open(tmp_path / "big.jpg", "wb") as file:
        file.truncate(101 << 20)
    assert column(files.file_listing(spark, str(tmp_path)), "file_size") == [101 << 20]
    assert column(files.file_inventory(spark, str(tmp_path)), "file_size") == [101 << 20]


def test_scratch_tables_go_to_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    settled = settle(spark.range(3).withColumnRenamed("id", "n"), "numbers")
    assert settled.inputFiles()[0].startswith(f"file://{shared_dir(spark)}/numbers-") and settled.count() == 3


class NoSharedFolder:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "local-cluster[2,1,1024]" if key == "spark.master" else default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(NoSharedFolder)


def test_files_are_written_without_a_process_per_file(spark, tmp_path):
    """A few hundred files with Spark's writer took as many ``chmod`` processes; contents and hidden rests are told."""
    count = 400
    rows = spark.range(count).selectExpr("concat(id div 100, '/doc_id=', id, '/text.txt') as path", "concat('ü', id) as content")
    for _ in range(2):  # as after a repeated task
        sinks.write_files(rows, f"file://{tmp_path}/tree")
    found = {str(p.relative_to(tmp_path / "tree")): p.read_text() for p in (tmp_path / "tree").rglob("*") if p.is_file()}
    assert found == {f"{i // 100}/doc_id={i}/text.txt": f"ü{i}" for i in range(count)}
    read = files.file_inventory(spark, str(tmp_path / "tree"), extensions=["TXT"])
    assert read.select("hash").distinct().count() == count
    assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
