"""Conflict-free target names, without a loop.

Of all files that want one name in one folder, the first in walk order gets it if it is
free. The others, in order of a hash of their paths, take ``stem_1.ext``, ``stem_2.ext`` and so
on, skipping suffixes that are in use or that another incoming file brings along as its own
name. Suffixes have no end unless the caller sets one.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import name_stem, raw_extension, suffixed_name, walk_key
from ..session import unsettled

SUFFIXED = r"_([1-9][0-9]{0,17})(\.[^./]*)?$"
#: Suffixes numbered in one go.
BLOCK = 4096


def _names_in_use(names: DataFrame, wanted: Column, own: Column) -> DataFrame:
    """Rows (target_dir, wanted, own, suffix): each name itself, and the name it is a suffixed form of."""
    suffix = F.regexp_extract("wanted", SUFFIXED, 1)
    stem = F.left(name_stem("wanted"), F.length(name_stem("wanted")) - F.length(suffix) - 1)
    itself = F.struct(F.col("wanted"), own.alias("own"), F.lit(None).cast("bigint").alias("suffix"))
    suffixed = F.struct(
        F.concat(stem, raw_extension("wanted")).alias("wanted"),
        F.lit(False).alias("own"),
        suffix.try_cast("bigint").alias("suffix"),
    )
    uses = F.array_compact(F.array(F.when(own, itself), F.when(suffix != "", suffixed)))
    return names.select("target_dir", wanted.alias("wanted")).select("target_dir", F.inline(uses))


def _numbered(rows: DataFrame, group: list[str], part: str, *order: Column | str) -> DataFrame:
    """``turn``: the place of each row of a group, from 1. Parts of a group are numbered on their own
    and shifted by the rows of the parts before, so a large group is spread over tasks."""
    counted = rows.groupBy(*group, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select(*group, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))
    placed = rows.withColumn("place", place).join(shifts, [*group, part])
    return placed.withColumn("turn", F.col("shift") + F.col("place")).drop("shift", "place")


def assigned_names(
    files: DataFrame,
    taken: DataFrame | None = None,
    key: str = "path",
    ignore_case: bool = False,
    max_suffix: int | None = None,
    at: Callable[[DataFrame, str], DataFrame] = unsettled,
) -> DataFrame:
    """Rows (key, target_dir, final_name) for the files that get a name: all, unless suffixes are limited.

    ``files`` has ``target_dir``, ``name``, ``path`` and a unique ``key``; ``taken`` lists the
    (target_dir, name) pairs in use; it need hold no more than the folders that files go to.
    Files in wait of a suffix are numbered in parts by a hash of their path, free suffixes in blocks
    of numbers, and the two meet in a join on the number, so any number of files may want one name.
    ``at`` may write down the claims, which are read several times.
    """

    def fold(name: str) -> Column:
        return F.lower(name) if ignore_case else F.col(name)

    group = ["target_dir", "wanted"]
    claims = files.select(F.col(key).alias("claimant"), "target_dir", "name", "path", fold("name").alias("wanted"))
    in_use = _names_in_use(files, fold("name"), F.lit(False))
    if taken is not None:
        in_use = in_use.unionByName(_names_in_use(taken, fold("name"), F.lit(True)))
    uses = at(in_use.groupBy(*group, "suffix").agg(F.bool_or("own").alias("own")), "names-in-use")
    queues = claims.groupBy(*group).agg(
        F.min(F.struct(walk_key("path").alias("key"), "claimant"))["claimant"].alias("first"), F.count("*").alias("claims")
    )
    used = uses.groupBy(*group).agg(F.bool_or("own").alias("own_taken"), F.count("suffix").alias("n_used"))
    queues = queues.join(used, group, "left").select(
        *group,
        F.when(~F.coalesce("own_taken", F.lit(False)), F.col("first")).alias("first"),
        "claims",
        F.coalesce("n_used", F.lit(0)).alias("n_used"),
    )
    waiting = F.col("claims") - F.col("first").isNotNull().cast("int")
    placed = at(claims.join(queues.hint("rebalance"), group), "claims")
    owner = F.coalesce(F.col("claimant") == F.col("first"), F.lit(False))
    named = placed.where(owner).select(F.col("claimant").alias(key), "target_dir", F.col("name").alias("final_name"))

    late = placed.where(~owner).drop("first", "claims", "n_used").withColumns({"digest": F.md5("path"), "part": F.left(F.md5("path"), F.lit(4))})
    late = _numbered(late, group, "part", "digest", "path", "claimant")
    last = (waiting + F.col("n_used")).cast("bigint")
    spans = placed.where(owner | F.col("first").isNull()).where(waiting > 0).select(*group, last.alias("last")).distinct()
    blocks = spans.withColumn("block", F.explode(F.expr(f"sequence(0L, (last - 1) div {BLOCK})")))
    blocks = blocks.repartition(*group, "block")
    numbers = F.expr(f"sequence(block * {BLOCK} + 1, least((block + 1) * {BLOCK}, last))")
    free = blocks.select(*group, "block", F.explode(numbers).alias("suffix"))
    free = free.join(uses.select(*group, "suffix"), [*group, "suffix"], "left_anti")
    free = _numbered(free, group, "block", "suffix")
    if max_suffix is not None:
        free = free.where(F.col("suffix") <= max_suffix)
    found = late.join(free.select(*group, "turn", "suffix"), [*group, "turn"])
    suffixed = found.select(F.col("claimant").alias(key), "target_dir", suffixed_name("name", F.col("suffix")).alias("final_name"))
    return named.unionByName(suffixed)


def resolve_name_conflicts(
    files: DataFrame,
    taken: DataFrame | None = None,
    key: str = "path",
    ignore_case: bool = False,
    max_suffix: int | None = None,
    at: Callable[[DataFrame, str], DataFrame] = unsettled,
) -> DataFrame:
    """All files with ``final_name``; null only where ``max_suffix`` leaves none."""
    names = assigned_names(files, taken, key, ignore_case, max_suffix, at).select(key, "final_name")
    return files.join(names, key, "left")
