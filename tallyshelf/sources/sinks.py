"""Where results go: action plans, reports, plain files and the organised library."""

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CATALOG_ACTION, MOVE, REPLACE_STALE


def write_action_plan(plan: DataFrame, path: str) -> None:
    """Record what happens to every file."""
    plan.write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """Several reports, one folder each."""
    for name, report in reports.items():
        write_report(report, f"{root}/{name}")


def with_content(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of kept files with their bytes.

    File contents are the bulk of the data. Spark sends the list of kept files to where contents are
    read while it is small, and cuts contents by its runtime Bloom filter before it shuffles them
    otherwise. The plan should be a written table.
    """
    kept = plan.where(F.col("action").isin(MOVE, CATALOG_ACTION, REPLACE_STALE)).select("path", "target_path")
    return files.select("path", "content").join(kept, "path")


#: The day folder and the name at the end of a target path.
DAY = r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/[^/]*$"


def write_library(kept: DataFrame, root: str, batch: int = 0) -> None:
    """Put kept files below ``root``, in folders of the batch and the year, month and day of their target path.

    Writing a batch again replaces it. Rows are not moved between tasks: each task writes into the
    folders its rows belong to, so a day that holds most of the files is still written by many tasks.
    """
    parts = {name: F.regexp_extract("target_path", DAY, k) for k, name in enumerate(("year", "month", "day"), 1)}
    kept.withColumns(parts).write.partitionBy(*parts).mode("overwrite").parquet(f"{root}/batch={batch}")


def write_files(files: DataFrame, root: str) -> None:
    """One file per row: ``content`` at ``path`` below ``root``, a folder all executors share.

    Spark's own writers start up to four ``chmod`` processes a file on a local file system without Hadoop's native
    library, and rename folder by folder in the driver. Here each task writes its rows through Arrow, under a hidden
    name first, so that a repeated task leaves whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                folder, name = posixpath.split(f"{top}/{path}")
                system.create_dir(folder)
                unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as out:
                    out.write(content or b"")
                system.move(unfinished, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"files": [len(batch)]}, pa.schema([("files", pa.int64())]))

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()
