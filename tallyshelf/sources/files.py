"""Folders as tables: trees that tasks can open are walked by tasks, others go through Spark's binary-file source.

Both leave out names that begin with ``.`` or ``_`` and files without content.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name, content_hash, file_extension
from ..functions.hashing import hash_algorithm
from ..operators.filters import clean_extensions, filter_max_size
from ..schemas import BINARY
from ..session import shared_dir
from .tree_stream import TreeSource
from .walk import contents, ending, folder_path, local_path, walked


#: What opening a file counts as when files are dealt to tasks. Spark's 4 MB make a task of every 32 small files.
OPEN_COST = "spark.sql.files.openCostInBytes"
DEFAULT_COST = "4194304b"
SMALL_FILE = "65536b"


def extension_glob(extensions: Sequence[str]) -> str:
    """File name pattern that matches the extensions in any case, so listing prunes the rest."""

    def any_case(text: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)

    return "*{" + ",".join(any_case(e) for e in clean_extensions(extensions)) + "}"


def _binary(reader, extensions: Sequence[str] | None):
    """Options shared by batch and stream; files that vanish or cannot be read are left out."""
    reader = (
        reader.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
    )
    return reader.option("pathGlobFilter", extension_glob(extensions)) if extensions else reader


def pack_small_files(spark: SparkSession) -> None:
    """Let a task read some thousand small files. There is no such option of a single read; a session's own setting stays."""
    if spark.conf.get(OPEN_COST) == DEFAULT_COST:
        spark.conf.set(OPEN_COST, SMALL_FILE)


def read_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """path, modificationTime, length and content of every file below ``root``."""
    pack_small_files(spark)
    return _binary(spark.read, extensions).load(root)


def new_file_stream(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of new files below ``root``, those in new sub-folders included.

    Unless there is a limit to a trigger's files, a tree that tasks can open is listed without Spark's file source.
    """
    local, shared = folder_path(spark, root, extensions), local_path(spark, shared_dir(spark))
    if local is not None and shared is not None and not max_files_per_trigger:
        spark.dataSource.register(TreeSource)
        logs = f"{shared}/new-files-{uuid.uuid4().hex}"
        return spark.readStream.format(TreeSource.name()).options(root=local.rstrip("/"), ending=ending(extensions), logs=logs).load()
    pack_small_files(spark)
    reader = _binary(spark.readStream.schema(BINARY), extensions)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(root)


def plain_path(path: str) -> Column:
    """Local paths without their ``file:`` scheme, so that they compare equal to stored ones."""
    return F.regexp_replace(F.col(path), r"^file:(//)?(?=/)", "")


def listed(files: DataFrame, *more: Column) -> DataFrame:
    """Inventory columns that need no content, from rows of the binary source, and ``more``."""
    path = plain_path("path")
    return files.select(
        path.alias("path"),
        base_name(path).alias("name"),
        file_extension(path).alias("extension"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
        *more,
    )


def hashed(files: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Full inventory rows from rows of the binary source."""
    return listed(
        files,
        content_hash("content", algorithm).alias("hash"),
        F.lit(hash_algorithm(algorithm)).alias("hash_type"),
    )


def file_listing(
    spark: SparkSession, root: str, extensions: Sequence[str] | None = None, max_size: int | None = None
) -> DataFrame:
    """Names, sizes and times of the files below ``root``; no content is opened."""
    local = folder_path(spark, root, extensions)
    files = read_files(spark, root, extensions) if local is None else walked(spark, local, extensions)
    return listed(filter_max_size(files, max_size, "length"))


def file_inventory(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] | None = None,
    max_size: int | None = None,
    algorithm: str | None = None,
) -> DataFrame:
    """Every file below ``root`` with its content hash.

    There is no size cap unless the caller gives one. The name pattern acts when the folder is listed, which is when this
    is called, and the cap before content is read and again on the size it then has.
    A file is hashed where it is read and its bytes go no further. ``settle`` the result before
    it takes part in more than one branch of a plan.
    """
    local = folder_path(spark, root, extensions)
    if local is None:
        return hashed(filter_max_size(read_files(spark, root, extensions), max_size, "length"), algorithm)
    files = contents(filter_max_size(walked(spark, local, extensions), max_size, "length"))
    return hashed(filter_max_size(files, max_size, "length"), algorithm)
