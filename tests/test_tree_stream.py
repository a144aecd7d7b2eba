"""New files of a tree, over several listings and runs."""

import shutil

import pytest

from tallyshelf.sources import files, tree_stream, walk
from tallyshelf.sources.tree_stream import TreeReader
from tallyshelf.streaming import events


def feed(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)


def names(root, partitions):
    return sorted(path[len(str(root)) + 1 :] for part in partitions for path in tree_stream.paths_of(part.value))


@pytest.fixture
def reader(tmp_path, monkeypatch):
    monkeypatch.setattr(tree_stream, "FILES", 3)
    return lambda: TreeReader(str(tmp_path / "in"), walk.ending(["txt"]), str(tmp_path / "logs"))


def test_offsets_name_what_is_new(tmp_path, reader):
    root, one = tmp_path / "in", reader()
    feed(root, *(f"{k}/a{k}.txt" for k in range(10)), "b.jpg", "_c.txt")
    start, first = one.initialOffset(), one.latestOffset()
    assert one.latestOffset() == first and one.seen.nbytes == 16 * 10
    assert names(root, one.partitions(start, first)) == sorted(f"{k}/a{k}.txt" for k in range(10)) and len(one.partitions(start, first)) == 4
    assert one.partitions(first, first) == []
    feed(root, "new/a.txt", "3/a3.txt")
    second = one.latestOffset()
    assert names(root, one.partitions(first, second)) == ["new/a.txt"]
    assert len(names(root, reader().partitions(start, second))) == 11  # a replay by another process


def test_a_new_run_goes_on(tmp_path, reader):
    root, one = tmp_path / "in", reader()
    feed(root, *(f"a{k}.txt" for k in range(7)))
    end = one.latestOffset()
    (root / "a1.txt").unlink()
    feed(root, "late.txt")
    two = reader()
    then = two.latestOffset()
    assert names(root, two.partitions(end, then)) == ["late.txt"] == names(root, reader().partitions(end, then))
    feed(root, "a1.txt", "later.txt")
    last = two.latestOffset()
    assert names(root, two.partitions(then, last)) == ["later.txt"]
    three = reader()
    assert three.partitions(last, three.latestOffset()) == []
    shutil.rmtree(one.log)
    with pytest.raises(FileNotFoundError):
        four = reader()
        four.partitions(end, four.latestOffset())


def test_two_runs_of_a_query(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    feed(root, "a.txt", "sub/b c.TXT", "ü.txt", "d.jpg")
    for more in (["a.txt", "sub/new.txt"], []):
        stream = files.hashed(files.new_file_stream(spark, f"file://{root}", ["txt"]))
        query = events.start_append(stream, out, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert "FileStreamSource" not in str(query.lastProgress)
        feed(root, *more)
    got = spark.read.schema(stream.schema).parquet(out)
    want = files.file_inventory(spark, str(root), ["txt"])
    assert sorted(got.drop("modified_at").collect()) == sorted(want.drop("modified_at").collect())
    assert got.where("name <> 'a.txt'").exceptAll(want).count() == 0


def test_a_limit_is_kept(spark, tmp_path):
    feed(tmp_path / "in", *(f"a{k}.txt" for k in range(5)))
    stream = files.new_file_stream(spark, str(tmp_path / "in"), ["txt"], 2).drop("content")
    query = events.start_append(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress] == [2, 2, 1]
