"""Tries of files that come, go and come back."""

from tallyshelf.sources import files
from tallyshelf.streaming import tries

from .test_operators import column


def batch(spark, tmp_path, number, listing, root):
    offered = tries.offered(listing, root, number)
    read = files.file_inventory(spark, str(tmp_path / "in"))
    tries.try_files(offered, read, root, number)
    return offered


def test_three_tries_then_an_error(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    for name in ("good.jpg", "lost.jpg", "back.jpg"):
        (folder / name).write_bytes(name.encode())
    listing = spark.createDataFrame(files.file_listing(spark, str(folder)).collect(), tries.LISTED)
    for name in ("lost.jpg", "back.jpg"):
        (folder / name).unlink()
    none = listing.limit(0)
    batch(spark, tmp_path, 0, listing, root)
    assert {r.name: r.tries for r in tries.tries(spark, root).collect()} == {"lost.jpg": 1, "back.jpg": 1}
    (folder / "back.jpg").write_bytes(b"again")
    for _ in range(2):  # a replay counts once
        offered = batch(spark, tmp_path, 1, none, root)
        assert column(offered, "name") == ["back.jpg", "lost.jpg"]
    assert {r.name: r.tries for r in tries.tries(spark, root).collect()} == {"lost.jpg": 2}
    assert tries.errors(spark, root).count() == 0
    (folder / "back.jpg").unlink()
    offered = batch(spark, tmp_path, 2, listing.where("name = 'back.jpg'"), root)
    assert column(offered, "name") == ["back.jpg", "lost.jpg"]
    (error,) = tries.errors(spark, root).collect()
    assert (error.name, error.action, error.reason, error.tries, error.batch) == ("lost.jpg", "ERROR", "not readable", 3, 2)
    assert {r.name: r.tries for r in tries.tries(spark, root).collect()} == {"lost.jpg": 3, "back.jpg": 1}
    offered = batch(spark, tmp_path, 3, none, root)
    assert column(offered, "name") == ["back.jpg"]


def test_reasons_and_empty_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root = str(tmp_path / "ledger")
    listing = spark.createDataFrame([("/x/a.jpg", "a.jpg", ".jpg", 1, None), ("/x/a.jpg", "a.jpg", ".jpg", 1, None)], tries.LISTED)
    read = spark.createDataFrame([("/x/a.jpg", None)], "path string, hash string")
    for number in range(2):
        tries.try_files(tries.offered(listing if not number else listing.limit(0), root, number), read, root, number, most=2, reason="cannot open")
    assert [(r.reason, r.tries, r.hash) for r in tries.errors(spark, root).collect()] == [("cannot open", 2, None)]
    tries.try_files(listing.limit(0), read, root, 2)
    assert tries.errors(spark, root).count() == 1
