"""Lookups by the index against all records, and what their plans read."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyshelf.plans import plan_ingest
from tallyshelf.session import settle
from tallyshelf.sources import catalog_index, catalog_parts, catalog_store

from .test_operators import column, inventory, records


def store(spark, root, sizes):
    """Segments of so many records each; hashes h0, h1, ... in all."""
    made = 0
    for batch, size in enumerate(sizes):
        rows = records(spark, [(k + 1, f"h{k}", f"/s/{k}.jpg", f"/lib/{k % 7}/{k}.jpg") for k in range(made, made + size)])
        catalog_store.append_catalog(rows, root, batch)
        made += size
    return made


def hashes(spark, names):
    return settle(spark.createDataFrame([(n,) for n in names], "hash string"), "hashes")


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(catalog_index, "PER_RANGE", 8)


def test_lookup_finds_every_record(spark, tmp_path, small_ranges):
    root = str(tmp_path / "catalog")
    n = store(spark, root, [300, 0, 1, 8, 9, 40, 2, 5, 20, 3])
    wanted = [f"h{k}" for k in range(0, n, 3)] + ["h0", "unknown", ""]
    found = catalog_index.find_records(spark, root, hashes(spark, wanted))
    assert column(found, "hash") == sorted(f"h{k}" for k in range(0, n, 3))
    known = {r.hash: r for r in catalog_store.read_segments(spark, root).collect()}
    assert len(known) == n and all(known[r.hash] == r for r in found.collect())
    early = catalog_index.find_records(spark, root, hashes(spark, ["h0", f"h{n - 1}"]), before=9)
    assert column(early, "hash") == ["h0"]


def test_only_named_ranges_are_read_and_the_catalog_stays(spark, tmp_path, small_ranges):
    root = str(tmp_path / "catalog")
    store(spark, root, [400] + [10] * 9)
    found = catalog_index.find_records(spark, root, hashes(spark, ["h3", "h405"]))
    folders = {re.search(r"batch=(\d+)/range=(\w+)", f).groups() for f in found.inputFiles() if "batch=" in f}
    assert 2 <= len(folders) <= 6 and {b for b, _ in folders} >= {"0", "1"}
    assert len({r.range for r in catalog_parts.side_table(spark, root, "index", catalog_index.INDEX, 1).collect()}) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert column(found, "hash") == ["h3", "h405"]


def test_an_absent_hash_is_seldom_looked_for(spark, tmp_path):
    root = str(tmp_path / "catalog")
    store(spark, root, [500, 500])
    hits = [catalog_index.hit_ranges(spark, root, hashes(spark, [f"no{k}"])).count() for k in range(20)]
    assert sum(hits) <= 4
    assert catalog_index.find_records(spark, root, hashes(spark, [])).count() == 0
    assert catalog_index.find_records(spark, str(tmp_path / "none"), hashes(spark, ["h1"])).count() == 0


def test_a_replayed_segment_replaces_itself(spark, tmp_path, small_ranges):
    root = str(tmp_path / "catalog")
    for size in (300, 20):
        store(spark, root, [size])
    assert catalog_store.read_segments(spark, root).count() == 20
    assert column(catalog_index.find_records(spark, root, hashes(spark, ["h1", "h250"])), "hash") == ["h1"]


def test_a_plan_sends_the_batch_and_not_the_catalog(spark, tmp_path):
    """A catalog that is too large to be sent is cut before it takes part in a join."""
    path = str(tmp_path / "big")
    spark.range(200_000).selectExpr(
        "id", "sha2(cast(id as string), 256) as hash", "'n' as original_name", "1L as file_size", "'.jpg' as extension",
        "timestamp_ntz'2024-01-01 00:00:00' as created_at", "timestamp_ntz'2024-01-01 00:00:00' as processed_at",
        "concat('/s/', id) as source_path", "concat('/lib/', id) as target_path", "'sha256' as hash_type",
    ).write.parquet(path)
    files = settle(inventory(spark, [("/s/a.jpg", "x"), ("/s/b.jpg", "y")]), "files")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100kb")
    try:
        from tallyshelf.plans.files import content_verdicts

        plan = content_verdicts(files, spark.read.parquet(path), None)._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("big")].splitlines()[::-1]
        first = next(line for line in above if "Join" in line or "Exchange" in line)
        assert "LeftSemi" in first
        assert plan_ingest(files, spark.read.parquet(path), "/lib", "2024-01-01 00:00:00").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def hash_ids(rows):
    return sorted((r.hash, r.id) for r in rows.collect())


def some(spark, *pairs):
    return settle(records(spark, [(i, h, f"/s/{h}", f"/lib/2024/{h}.jpg") for h, i in pairs]), "records")


def test_deletes_hide_earlier_batches_only(spark, tmp_path):
    root = str(tmp_path / "catalog")
    catalog_store.init_segments(spark, root, some(spark, ("a", 1), ("b", 2), ("c", 3)))
    catalog_store.append_catalog(some(spark, ("d", 4)), root, 0)
    for _ in range(2):
        catalog_store.replace_stored(some(spark, ("a", 5)), root, 1)
        catalog_store.delete_stored(hashes(spark, ["d", "d", None, "unknown"]), root, 2)
        catalog_store.append_catalog(some(spark), root, 2)
    catalog_store.append_catalog(some(spark, ("d", 6)), root, 3)
    states = {0: "a1 b2 c3", 1: "a1 b2 c3 d4", 2: "a5 b2 c3 d4", 3: "a5 b2 c3", 4: "a5 b2 c3 d6", None: "a5 b2 c3 d6"}
    wanted = hashes(spark, ["a", "d", "x"])
    for before, state in states.items():
        assert [f"{h}{i}" for h, i in hash_ids(catalog_store.read_segments(spark, root, before))] == state.split()
        found = [f"{h}{i}" for h, i in hash_ids(catalog_index.find_records(spark, root, wanted, before))]
        assert found == [s for s in state.split() if s[0] in "ad"]
        names = catalog_index.names_below(spark, root, "/lib", before).collect()
        assert sorted(r.name[0] for r in names) == [s[0] for s in state.split()]


@pytest.mark.parametrize("fan", [3])
def test_folding_changes_no_state(spark, tmp_path, fan):
    """Every state that could be read before can be read after, also when a batch is replayed."""
    root, batches = str(tmp_path / "catalog"), 9
    catalog_store.init_segments(spark, root, some(spark, *((f"h{k}", k) for k in range(40))))
    for batch in range(batches):
        fresh = [(f"h{40 + 3 * batch + k}", 100 + 3 * batch + k) for k in range(3 if batch % 4 else 0)]
        catalog_store.replace_stored(some(spark, *fresh, (f"h{batch}", 1000 + batch)), root, batch)
        if batch % 3 == 0:
            gone = hashes(spark, [f"h{batch}", f"h{30 - batch}", f"h{41 + 3 * batch - 6}"])
            catalog_store.delete_stored(gone, root, batch)
    bounds = [5, 8, None]
    states = {b: hash_ids(catalog_store.read_segments(spark, root, b)) for b in bounds}
    names = sorted(catalog_index.names_below(spark, root, "/lib").collect())
    done = catalog_store.fold_segments(spark, root, before=batches - 1, fan=fan)
    assert done and all(part.high < batches - 1 for part in done)
    assert catalog_store.fold_segments(spark, root, before=batches - 1, fan=fan) == []
    assert {b: hash_ids(catalog_store.read_segments(spark, root, b)) for b in bounds} == states
    assert sorted(catalog_index.names_below(spark, root, "/lib").collect()) == names
    asked = hashes(spark, [f"h{k}" for k in range(0, 80, 2)])
    found = hash_ids(catalog_index.find_records(spark, root, asked))
    assert found == [(h, i) for h, i in states[None] if int(h[1:]) % 2 == 0]
    parts = catalog_store.catalog_parts(spark, root, fan=fan)
    assert len(parts) < batches + 1 and [p.low for p in parts[1:]] == [p.high + 1 for p in parts[:-1]]


def test_a_fold_nobody_announced_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "catalog")
    store(spark, root, [2, 2, 2])
    state = hash_ids(catalog_store.read_segments(spark, root))
    catalog_index.write_segment(some(spark, ("half", 9)), f"{root}/merged/-1_1", 1)
    assert hash_ids(catalog_store.read_segments(spark, root)) == state
    assert [(p.low, p.high) for p in catalog_store.fold_segments(spark, root, fan=3)] == [(-1, 2)]
    assert hash_ids(catalog_store.read_segments(spark, root)) == state
    read = catalog_store.read_segments(spark, root).select(F.input_file_name().alias("file")).collect()
    assert {r.file.split("/catalog/")[1].split("/")[0] for r in read} == {"merged"}


def test_folding_may_keep_only_the_newest_record(spark, tmp_path):
    root = str(tmp_path / "catalog")
    for batch, pairs in enumerate([[("a", 1), ("b", 2)], [("a", 3)], [("b", 1)]]):
        catalog_store.append_catalog(some(spark, *pairs), root, batch)
    catalog_store.fold_segments(spark, root, fan=3, newest_only=True)
    assert hash_ids(catalog_store.read_segments(spark, root)) == [("a", 3), ("b", 2)]


def test_parts_due_for_a_merge():
    def parts(levels):
        return [catalog_parts.Part("", k, k, int(level)) for k, level in enumerate(levels)]

    def next_run(levels, fan):
        found = catalog_parts.due(parts(levels), fan)
        return found and ([part.low for part in found[0]], found[1])

    assert next_run("", 2) is None and next_run("0", 2) is None and next_run("3210", 2) is None
    assert next_run("3000", 3) == ([1, 2, 3], 1)
    assert next_run("30020", 3) is None and next_run("30020", 2) == ([1, 2], 1)
    assert next_run("3010110", 3) == ([1, 2, 3, 4, 5, 6], 2)


def test_folding_rewrites_a_record_once_a_level():
    """Many small batches, some larger ones, after a large start that is left alone for long."""
    fan, alive, rewritten, most = 4, [catalog_parts.Part("", -1, -1, 3)], Counter(), 0
    for batch in range(400):
        alive.append(catalog_parts.Part("", batch, batch, 1 if batch % 90 == 7 else 0))
        while chosen := catalog_parts.due(alive, fan):
            run, level = chosen
            rewritten.update(range(run[0].low, run[-1].high + 1))
            place = alive.index(run[0])
            alive[place : place + len(run)] = [catalog_parts.Part("", run[0].low, run[-1].high, level)]
        most = max(most, len(alive))
    top = max(part.level for part in alive)
    assert top == 4 and max(rewritten.values()) <= top and rewritten[-1] == 1
    assert most <= 4 * fan and [p.low for p in alive[1:]] == [p.high + 1 for p in alive[:-1]]
