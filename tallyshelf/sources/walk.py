"""Trees of files that tasks can open as local paths (a mounted share, or one machine): listed and read by tasks.

Spark's own file sources list in the driver and keep a kilobyte or two for each file there. Here the tree is walked in
turns: a task lists the folders it is given and those below, up to a number of entries, and the folders that are left are
dealt out anew. The driver sees how a turn ended, and no path. Listings are written tables.

What counts as a file is the same as in Spark's binary-file source: names that begin with ``.``, or with ``_`` unless
there is a ``=`` in them, and files without content are left out; so are those that vanish, or cannot be read.
"""

import os
import re
import stat
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import clean_extensions
from ..session import scratch_path, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of it
#: Entries a task lists in the first turn, times as many in each next one, and folders it keeps for itself.
ENTRIES, GROWTH, KEPT = 1_000, 16, 1_000
#: Rows of a batch of paths; bytes of content a task sends at a time, about.
ROWS, SENT = 4_096, 4 << 20
WALKED = "path string, is_folder boolean, modified_ms bigint, length bigint"
#: Characters that mean something else than themselves in Hadoop's patterns.
SPECIAL = re.compile(r"[*?\[\]{}\\,^!]")


def folder_path(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> str | None:
    """The folder's local path; none if it is not one that tasks can walk, or either argument is a pattern."""
    if SPECIAL.search(root) or any(SPECIAL.search(e) for e in extensions or ()):
        return None
    local = local_path(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return local if local is not None and system.exists(path) and system.getFileStatus(path).isDirectory() else None


def local_path(spark: SparkSession, place: str) -> str | None:
    """A place on a mounted file system as a plain path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def ending(extensions: Sequence[str] | None) -> str:
    """Pattern of the names that end in one of the extensions, in any case."""
    if not extensions:
        return ""
    any_case = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in e) for e in clean_extensions(extensions))
    return rf"(?s)^.*(?:{'|'.join(any_case)})\Z"


def is_seen(name: str, folder: bool) -> bool:
    """Whether Spark's file sources look at it."""
    hidden = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return not hidden or (folder and name.startswith(("_metadata", "_common_metadata")))


def shown(path: str) -> str:
    return path.encode(errors="replace").decode()


def entries_of(folder: str, named: re.Pattern) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """path, whether it is a folder, and time and size of a file, of what a folder has; a folder that is gone has nothing."""
    try:
        entries = os.scandir(folder or "/")
    except (FileNotFoundError, NotADirectoryError):
        return
    with entries:
        for entry in entries:
            path = f"{folder}/{entry.name}"
            try:
                if entry.is_dir():
                    if is_seen(entry.name, True):
                        yield path, True, None, None
                elif is_seen(entry.name, False) and named.search(entry.name):
                    found = entry.stat()
                    if stat.S_ISREG(found.st_mode) and found.st_size:
                        yield path, False, found.st_mtime_ns // 1_000_000, found.st_size
            except OSError:  # a link to nowhere, or gone
                continue


def read_files(paths: Iterable[str]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """path, time, length and content of files that can be read, some megabytes at a time."""
    rows, size = [], 0
    for path in paths:
        try:
            with open(path.removeprefix("file:"), "rb") as file:
                found, content = os.fstat(file.fileno()), file.read()
        except OSError:
            continue
        rows.append((path, found.st_mtime_ns // 1_000_000, found.st_size, content))
        size += len(content)
        if size >= SENT or len(rows) >= ROWS:
            yield rows
            rows, size = [], 0
    yield rows


def columns(rows: list[tuple], *kinds: pa.DataType) -> list[pa.Array]:
    return [pa.array(x, k) for x, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)]


def walked(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """path, modificationTime and length of every file below the local folder ``root``, as a written table."""
    wanted, out, cores = ending(extensions), scratch_path(spark, "walk"), spark.sparkContext.defaultParallelism

    def turn(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            named, left, rows = re.compile(wanted), most, []

            def sent() -> pa.RecordBatch:
                found = columns(rows, pa.string(), pa.bool_(), pa.int64(), pa.int64())
                rows.clear()
                return pa.RecordBatch.from_arrays(found, ["path", "is_folder", "modified_ms", "length"])

            for batch in batches:
                for given in batch["path"].to_pylist():
                    stack = [given]
                    while stack:
                        folder = stack.pop()
                        if left <= 0:
                            rows.append((shown(folder), True, None, None))
                            continue
                        left -= 1
                        for path, is_folder, *found in entries_of(folder, named):
                            if is_folder and len(stack) < KEPT:
                                stack.append(path)
                            else:
                                rows.append((shown(path), is_folder, *found))
                                left -= not is_folder
                            if len(rows) >= ROWS:
                                yield sent()
                        if len(rows) >= ROWS:
                            yield sent()
            yield sent()

        return run

    folders, most, number = spark.range(0, 1, 1, 1).select(F.lit(root.rstrip("/")).alias("path")), ENTRIES, 0
    while True:
        at = f"{out}/turn={number}"
        folders.mapInArrow(turn(most), WALKED).write.parquet(at)
        below = spark.read.schema(WALKED).parquet(at).where("is_folder").select("path")
        if below.isEmpty():
            break
        folders, most, number = below.repartition(4 * cores, "path"), most * GROWTH, number + 1
    files = spark.read.schema(WALKED).parquet(out).where("not is_folder")
    # Paths are dealt by their hash, so that a folder of large files is read by many tasks.
    rows = files.select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_millis("modified_ms").alias("modificationTime"), "length")
    return settle(rows.repartition(4 * cores, "path"), "walked")


def contents(files: DataFrame) -> DataFrame:
    """Time, length and content of the files of a listing, as they are when read; those that cannot be are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in read_files(path for batch in batches for path in batch["path"].to_pylist()):
            found = columns(rows, pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(found, ["path", "modified_ms", "length", "content"])

    read = files.select("path").mapInArrow(run, "path string, modified_ms bigint, length bigint, content binary")
    return read.select("path", F.timestamp_millis("modified_ms").alias("modificationTime"), "length", "content")
