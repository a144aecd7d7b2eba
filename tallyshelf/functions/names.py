"""Paths and file names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col


def base_name(path: Column | str) -> Column:
    """Last element of a path."""
    return F.substring_index(col(path), "/", -1)


def raw_extension(path: Column | str) -> Column:
    """Text from the last dot of the last path element on, as written; empty if there is none."""
    return F.regexp_extract(col(path), r"(\.[^./]*)$", 1)


def file_extension(path: Column | str) -> Column:
    """Lower-cased extension with its dot: ``.bashrc`` is all extension, ``a.`` has the extension ``.``."""
    return F.lower(raw_extension(path))


def normalize_extension(extension: Column | str) -> Column:
    """Lower-case with a leading dot, as extension lists are stored."""
    lowered = F.lower(col(extension))
    return F.when(lowered.startswith("."), lowered).otherwise(F.concat(F.lit("."), lowered))


def name_stem(name: Column | str) -> Column:
    """File name without its extension."""
    name = col(name)
    return F.left(name, F.length(name) - F.length(raw_extension(name)))


def suffixed_name(name: Column | str, n: Column) -> Column:
    """``photo.jpg`` with n = 2 becomes ``photo_2.jpg``."""
    return F.concat(name_stem(name), F.lit("_"), n.cast("string"), raw_extension(name))


def date_path(ts: Column | str) -> Column:
    """``YYYY/MM/DD`` of a timestamp."""
    return F.date_format(col(ts), "yyyy/MM/dd")


def join_path(*parts: Column | str) -> Column:
    """Path elements joined by a slash."""
    return F.concat_ws("/", *(col(p) for p in parts))


def walk_key(path: Column | str) -> Column:
    """Sort key of a directory walk, which compares paths element by element.

    Plain text order differs: it puts ``a-c`` before ``a/b``. With a separator below every
    other character, text order is walk order, and stays a cheap comparison of bytes.
    """
    return F.replace(col(path), F.lit("/"), F.lit("\x00"))


def walked_path(key: Column | str) -> Column:
    """The path a walk key was made of."""
    return F.replace(col(key), F.lit("\x00"), F.lit("/"))
