"""A stream of the new files of a tree that tasks can open as local paths.

Spark's file stream keeps the status of every file in the driver and plans a batch path by path. Here the driver holds 16
bytes a file, a digest of its path. New files are noted in a log, a folder of the shared one: a segment for each time the
tree was found to have some, in parts of some thousand paths. An offset names a log and a number of segments; a task reads
the files of a part.

A query that is started again has a log of its own. The first batch then has what that log has and the one before had not
seen, and what the older log had seen is carried over; if that log is gone, the query fails. A path counts as new once, whatever becomes of the file. Files that
vanish before they are read are left out.
"""

import os
import re
import sys
from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .walk import columns, entries_of, read_files, shown

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of it
#: Files and bytes of a part, about.
FILES, BYTES = 4_096, 128 << 20


def digests(paths: list[str]) -> np.ndarray:
    return np.array([blake2b(p.encode(), digest_size=16).digest() for p in paths], "S16")


def new_of(digest: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which are not in a sorted array."""
    if not len(seen):
        return np.ones(len(digest), bool)
    return seen[np.minimum(np.searchsorted(seen, digest), len(seen) - 1)] != digest


def parts(folder: str) -> list[str]:
    return sorted(f"{folder}/{name}" for name in os.listdir(folder))


def paths_of(part: str) -> list[str]:
    return pq.read_table(part)["path"].to_pylist()


def seen_by(log: str, segments: int) -> np.ndarray:
    """Sorted digests of what a log knew after some segments."""
    older = parts(f"{log}/before") if os.path.isdir(f"{log}/before") else []
    found = [np.array(pq.read_table(part)["digest"].to_pylist(), "S16") for part in older]
    found += [digests(paths_of(part)) for k in range(segments) for part in parts(f"{log}/{k}")]
    return np.unique(np.concatenate([np.zeros(0, "S16"), *found]))


class Folder:
    """Parts of paths on their way into a folder, which is there once all are."""

    def __init__(self, path: str):
        self.path, self.at, self.number, self.rows, self.size = path, f"{path}.{uuid4().hex}", 0, [], 0

    def add(self, path: str, size: int) -> None:
        self.rows.append((path, size))
        self.size += size
        if len(self.rows) >= FILES or self.size >= BYTES:
            self.cut()

    def cut(self) -> None:
        if self.rows:
            os.makedirs(self.at, exist_ok=True)
            table = pa.Table.from_arrays(columns(self.rows, pa.string(), pa.int64()), ["path", "length"])
            pq.write_table(table, f"{self.at}/{self.number:08d}.parquet")
            self.number, self.rows, self.size = self.number + 1, [], 0

    def done(self) -> bool:
        """Whether there is anything in it."""
        self.cut()
        if self.number:
            os.rename(self.at, self.path)
        return bool(self.number)


class TreeReader(DataSourceStreamReader):
    def __init__(self, root: str, ending: str, logs: str):
        self.root, self.ending, self.log = root, ending, f"{logs}/{uuid4().hex}"
        self.segments, self.seen = 0, np.zeros(0, "S16")

    def initialOffset(self) -> dict:
        return {"log": self.log, "segments": 0}

    def latestOffset(self) -> dict:
        """List the tree, and note what is new."""
        named, stack, out, added, some = re.compile(self.ending), [self.root], Folder(f"{self.log}/{self.segments}"), [], []

        def note() -> None:
            digest = digests([p for p, _ in some])
            new = new_of(digest, self.seen)
            added.append(digest[new])
            for (path, size), is_new in zip(some, new):
                if is_new:
                    out.add(path, size)
            some.clear()

        while stack:
            for path, is_folder, _, size in entries_of(stack.pop(), named):
                if is_folder:
                    stack.append(path)
                else:
                    some.append((shown(path), size))
                if len(some) >= FILES:
                    note()
        note()
        if out.done():
            self.segments += 1
            self.seen = np.sort(np.concatenate([self.seen, *added]))
        return {"log": self.log, "segments": self.segments}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        log = end["log"]
        if start["log"] == log:
            return [InputPartition(part) for k in range(start["segments"], end["segments"]) for part in parts(f"{log}/{k}")]
        before = seen_by(start["log"], start["segments"])
        if log == self.log and not os.path.isdir(f"{log}/before"):
            self.seen = np.union1d(self.seen, before)
            at = f"{log}/before.{uuid4().hex}"
            os.makedirs(at)
            pq.write_table(pa.table({"digest": pa.array(before.tolist(), pa.binary())}), f"{at}/0.parquet")
            os.rename(at, f"{log}/before")
        rest = f"{log}/{end['segments']}-since-{start['segments']}-of-{os.path.basename(start['log'])}"
        if not os.path.isdir(rest):
            out = Folder(rest)
            for part in (part for k in range(end["segments"]) for part in parts(f"{log}/{k}")):
                table = pq.read_table(part)
                new = new_of(digests(table["path"].to_pylist()), before)
                for row in table.filter(pa.array(new)).to_pylist():
                    out.add(row["path"], row["length"])
            if not out.done():
                return []
        return [InputPartition(part) for part in parts(rest)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for rows in read_files(f"file:{path}" for path in paths_of(partition.value)):
            path, modified, length, content = columns(rows, pa.string(), pa.int64(), pa.int64(), pa.binary())
            time = pa.array([t * 1000 for t in modified.to_pylist()], pa.int64()).cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([path, time, length, content], ["path", "modificationTime", "length", "content"])


class TreeSource(DataSource):
    """Options: ``root``, ``ending`` (a pattern of names) and ``logs`` (a folder below the shared one), all local paths."""

    @classmethod
    def name(cls) -> str:
        return "tallyshelf_tree"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint, content binary"

    def streamReader(self, schema) -> TreeReader:
        return TreeReader(self.options["root"], self.options.get("ending", ""), self.options["logs"])
