"""Which files, events and records take part. All are plain predicates that reach the scan."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import base_name, file_extension, log_level_rank
from ..schemas import DEFAULT_EXTENSIONS, IMAGE_EXTENSIONS, LARGE_FILE_SIZE


def clean_extensions(extensions: Sequence[str]) -> list[str]:
    """Lower-case, each with its leading dot."""
    return [e if e.startswith(".") else f".{e}" for e in (x.lower() for x in extensions)]


def is_supported(path: Column | str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> Column:
    return file_extension(path).isin(clean_extensions(extensions))


def is_hidden(path: Column | str) -> Column:
    return base_name(path).startswith(".")


def is_temp(path: Column | str) -> Column:
    name = base_name(path)
    return name.startswith("~") | name.endswith(".tmp") | name.endswith(".temp") | name.contains(".part")


def filter_supported(files: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS, path: str = "path") -> DataFrame:
    """Files whose extension is listed, in any case; an empty list means the default one.

    An inventory's own ``extension`` column is used if there is one, as that test reaches the scan.
    """
    extensions = extensions or DEFAULT_EXTENSIONS
    if "extension" in files.columns:
        return files.where(F.col("extension").isin(clean_extensions(extensions)))
    return files.where(is_supported(path, extensions))


def filter_images(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with one of the fixed image and RAW extensions."""
    return filter_supported(files, IMAGE_EXTENSIONS, path)


def filter_max_size(files: DataFrame, max_size: int | None = None, size: str = "file_size") -> DataFrame:
    """Files up to a size; all without one. On the binary source this is pushed below the content read."""
    return files if max_size is None else files.where(F.col(size) <= max_size)


def filter_hidden(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop dot files."""
    return files.where(~is_hidden(path))


def filter_temp(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop editor and download leftovers; names are compared as written."""
    return files.where(~is_temp(path))


def filter_ready(files: DataFrame, max_size: int | None = None, size: str = "file_size") -> DataFrame:
    """Files that are complete enough to process: not empty, and up to a size if there is one."""
    return filter_max_size(files.where(F.col(size) > 0), max_size, size)


def filter_events(events: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """Create and write events of supported files, in batch or on a stream."""
    return events.where(F.col("op").isin("CREATE", "WRITE") & is_supported("path", extensions))


def file_by_hash(catalog: DataFrame, digest: str) -> DataFrame:
    """The record of one hash, or no row."""
    return catalog.where(F.col("hash") == digest)


def large_files(catalog: DataFrame, larger_than: int = LARGE_FILE_SIZE) -> DataFrame:
    return catalog.where(F.col("file_size") > larger_than)


def filter_log_level(events: DataFrame, minimum: str = "info", level: str = "level") -> DataFrame:
    """Log events at or above a level; an unknown minimum counts as info."""
    return events.where(log_level_rank(level) >= log_level_rank(F.lit(minimum)))
