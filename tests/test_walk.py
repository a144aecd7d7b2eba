"""The walk against Spark's own listing, and odd trees."""

import os

import pytest
from pyspark.sql import functions as F

from tallyshelf.sources import files, walk

NAMES = [
    "a.jpg", "b.JPG", "_h.jpg", "_x=1.jpg", "_metadata.jpg", ".d.jpg", "c.jpg._COPYING_", "none", "ü b.jpg", "x.tar.gz", "new\nline.jpg",
    "sub/a.jpg", "sub/k=1/a.txt", "_hidden/a.jpg", "_metadata/a.jpg", "_common_metadata2/b.jpg", "_k=1/a.jpg", ".git/a.jpg", "sub/deep/er/and/deeper/a.jpeg", "quo'te\"/a.jpg", "per%20cent/a%.jpg",
]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a tree"
    for name in NAMES + [f"many/{i}/{j}.jpg" for i in range(12) for j in range(3)]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    (root / "empty.jpg").write_bytes(b"")
    (root / "nothing").mkdir()
    os.utime(root / "a.jpg", ns=(0, 1_700_000_000_123_999_999))
    os.symlink(root / "sub", root / "linked")
    os.symlink(root / "gone", root / "broken.jpg")
    return root


def rows(df):
    return sorted((r.path, r.modificationTime, r.length, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("extensions", [None, ["jpg"], [".TXT", "gz", "ü"]])
@pytest.mark.parametrize("entries", [1, 7, 1_000])
def test_the_same_files_as_the_source(spark, tree, monkeypatch, entries, extensions):
    monkeypatch.setattr(walk, "ENTRIES", entries)
    monkeypatch.setattr(walk, "GROWTH", 2)
    monkeypatch.setattr(walk, "KEPT", entries)
    monkeypatch.setattr(walk, "ROWS", 5)
    local = walk.folder_path(spark, f"file://{tree}/", extensions)
    assert local == str(tree)
    got = walk.walked(spark, local, extensions)
    assert rows(walk.contents(got)) == rows(files.read_files(spark, str(tree), extensions))
    assert got.where(F.col("length") > 0).count() == got.count()


def test_the_driver_lists_no_tree(spark, tree):
    for df in (files.file_listing(spark, str(tree)), files.file_inventory(spark, str(tree))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "binaryFile" not in plan and "a tree" not in plan


def test_files_that_change_or_go(spark, tmp_path):
    for name in ("stays", "goes", "grows"):
        (tmp_path / name).write_bytes(b"1")
    inventory = files.file_inventory(spark, str(tmp_path), max_size=2)
    (tmp_path / "goes").unlink()
    (tmp_path / "grows").write_bytes(b"123")
    assert [r.name for r in inventory.collect()] == ["stays"]


def test_other_roots_go_through_the_source(spark, tree):
    assert walk.folder_path(spark, f"{tree}/su*") is None
    assert walk.folder_path(spark, f"{tree}/a.jpg") is None
    assert walk.folder_path(spark, f"{tree}/nowhere") is None
    assert walk.folder_path(spark, str(tree), ["j*"]) is None
    assert files.file_inventory(spark, f"{tree}/su*", ["jpg"]).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.file_inventory(spark, f"{tree}/nowhere")


def test_an_empty_folder(spark, tmp_path):
    assert files.file_inventory(spark, str(tmp_path)).count() == files.file_listing(spark, str(tmp_path)).count() == 0
