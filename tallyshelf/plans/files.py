"""What to do with every file of a folder. Every input file gets exactly one row.

Equal files are folded into one row per content first. Everything that is decided -- known
to the catalog or not, still on disk or not, which path survives, under which name -- is
decided on that smaller table, where every key is unique. The decision then goes back to all
files in one join on the hash, whose large side Spark may split where a content has very many
copies. Plans are lazy and start no job; they read the inventory several times, so it should be
a written table. ``ingest_folder`` sees to that.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name, date_path, join_path
from ..operators.catalog import existing_path_column, names_in_use, path_names, timestamp_column
from ..operators.dedup import survivors
from ..operators.filters import clean_extensions, is_hidden, is_temp
from ..operators.naming import assigned_names
from ..schemas import (
    ALREADY_CATALOGUED,
    CATALOG_ACTION,
    DEFAULT_EXTENSIONS,
    DELETE_DUPLICATE,
    ERROR,
    IMAGE_EXTENSIONS,
    MOVE,
    REPLACE_STALE,
    SKIP_DUPLICATE,
    SKIPPED,
)
from ..session import settle, unsettled
from ..sources.files import file_inventory

PLAN_COLUMNS = [
    "path", "name", "extension", "file_size", "modified_at", "hash", "hash_type",
    "action", "existing_path", "target_path", "reason",
]


def skip_reason(
    extensions: Sequence[str],
    max_size: int | None = None,
    skip_hidden: bool = False,
    skip_temp: bool = False,
    only_ready: bool = False,
) -> Column:
    """Why a file is not taken, or null."""
    reason = F.when(~F.col("extension").isin(clean_extensions(extensions)), "extension")
    if max_size is not None:
        reason = reason.when(F.col("file_size") > max_size, "size")
    if skip_hidden:
        reason = reason.when(is_hidden("path"), "hidden")
    if skip_temp:
        reason = reason.when(is_temp("path"), "temporary")
    if only_ready:
        reason = reason.when(F.col("file_size") <= 0, "empty")
    return reason


def content_verdicts(
    files: DataFrame, catalog: DataFrame, live_paths: DataFrame | None, carry: Sequence[str] = ()
) -> DataFrame:
    """Per hash: the surviving path, the copies, and the state of its catalog record.

    ``state`` is NEW, KNOWN, STALE or UNSURE. A record is known if its file is in ``live_paths`` or
    among ``files``; otherwise it is stale, or, without ``live_paths``, unsure: nothing shows that
    the original still exists. Only paths of matched records are looked up, by an inner join. The catalog
    is cut to the hashes of ``files`` first, by a join that can send the smaller side.
    """
    records = catalog.select("hash", existing_path_column().alias("existing_path"))
    records = records.join(files.select("hash"), "hash", "left_semi")
    verdicts = survivors(files, carry).join(records, "hash", "left")
    new = F.col("existing_path").isNull()
    seen = files.select("path")
    if live_paths is not None:
        seen = seen.unionByName(live_paths.select("path"))
    looked_up = verdicts.where(~new).select("hash", F.col("existing_path").alias("path"))
    alive = looked_up.join(seen, "path").select("hash").distinct().withColumn("seen", F.lit(True))
    lost = "UNSURE" if live_paths is None else "STALE"
    state = F.when(new, "NEW").when(F.col("seen"), "KNOWN").otherwise(lost)
    return verdicts.join(alive, "hash", "left").withColumn("state", state).drop("seen")


def _planned(inventory: DataFrame, files: DataFrame, verdicts: DataFrame, action: Column) -> DataFrame:
    """Attach the verdict of its content to every file and name its action; then all files not decided on."""
    verdict = verdicts.select("hash", "kept_path", "existing_path", "state", "kept_target").hint("rebalance")
    kept = F.col("action").isin(MOVE, CATALOG_ACTION, REPLACE_STALE)
    original = F.when(F.col("state") == "NEW", F.col("kept_target")).when(
        F.col("state") == "STALE", F.when(kept, F.col("existing_path")).otherwise(F.col("kept_target"))
    ).otherwise(F.col("existing_path"))
    planned = (
        files.join(verdict, "hash")
        .withColumn("action", action)
        .withColumn("target_path", F.when(kept, F.col("kept_target")))
        .withColumn(
            "existing_path",
            F.when(F.col("action") == ERROR, F.lit(None)).when(kept & (F.col("state") == "NEW"), F.lit(None)).otherwise(original),
        )
        .withColumn("reason", F.when(F.col("action") == ERROR, "no name left"))
    )
    none = F.lit(None).cast("string")
    others = inventory.where(F.col("reason").isNotNull() | F.col("hash").isNull()).withColumns(
        {
            "action": F.when(F.col("reason").isNull(), ERROR).otherwise(SKIPPED),
            "existing_path": none,
            "target_path": none,
            "reason": F.coalesce("reason", F.lit("not readable")),
        }
    )
    return planned.select(*PLAN_COLUMNS).unionByName(others.select(*PLAN_COLUMNS))


def plan_ingest(
    inventory: DataFrame,
    catalog: DataFrame,
    target_root: str,
    processed_at: Column | str | None = None,
    extensions: Sequence[str] = DEFAULT_EXTENSIONS,
    max_size: int | None = None,
    live_paths: DataFrame | None = None,
    taken: DataFrame | None = None,
    date_col: str | None = None,
    skip_hidden: bool = False,
    skip_temp: bool = False,
    only_ready: bool = False,
    max_suffix: int | None = None,
    at: Callable[[DataFrame, str], DataFrame] = unsettled,
) -> DataFrame:
    """Action plan for moving a folder into the library.

    ``catalog`` has one record per hash. ``live_paths`` lists every file that exists where catalog
    paths point; without it a known content is skipped and not deleted, as nothing shows that
    the original is there. ``taken`` lists the (target_dir, name) pairs in use; by default they are
    those of ``live_paths``, or without it those of the catalog. Files are dated by
    ``processed_at``, or by the inventory column ``date_col``. A file that is not taken is SKIPPED
    with the reason. A file without a hash could not be read and is an ERROR; so are a file for which
    ``max_suffix`` leaves no name and its copies: none of them may be deleted while the content is
    stored nowhere. The plan starts no job, unless ``at`` writes its named points down: with ``settle``
    nothing behind them is computed more than once.
    """
    inventory = inventory.withColumn(
        "reason", skip_reason(extensions or DEFAULT_EXTENSIONS, max_size, skip_hidden, skip_temp, only_ready)
    )
    files = inventory.where(F.col("reason").isNull() & F.col("hash").isNotNull())

    verdicts = at(content_verdicts(files, catalog, live_paths, [date_col] if date_col else []), "verdicts")
    day = date_path(F.col(date_col) if date_col else timestamp_column(processed_at))
    target_dir = join_path(F.lit(target_root.rstrip("/")), day)
    arriving = verdicts.where("state in ('NEW', 'STALE')").select(
        "hash", F.col("kept_path").alias("path"), base_name("kept_path").alias("name"), target_dir.alias("target_dir")
    )
    if taken is None:
        taken = names_in_use(catalog, target_root) if live_paths is None else path_names(live_paths)
    if date_col:
        taken = taken.join(arriving.select("target_dir").distinct(), "target_dir", "left_semi")
    else:
        taken = taken.where(F.col("target_dir") == target_dir)
    named = assigned_names(arriving, taken, key="hash", max_suffix=max_suffix, at=at).select(
        "hash", join_path("target_dir", "final_name").alias("kept_target")
    )
    verdicts = verdicts.join(named, "hash", "left")

    first = F.col("path") == F.col("kept_path")
    known = F.col("state").isin("KNOWN", "UNSURE")
    action = (
        F.when(known & (F.col("path") == F.col("existing_path")), ALREADY_CATALOGUED)
        .when(F.col("state") == "KNOWN", DELETE_DUPLICATE)
        .when(F.col("state") == "UNSURE", SKIP_DUPLICATE)
        .when(F.col("kept_target").isNull(), ERROR)
        .when(~first, DELETE_DUPLICATE)
        .when(F.col("state") == "STALE", REPLACE_STALE)
        .otherwise(MOVE)
    )
    return _planned(inventory, files, verdicts, action)


def plan_scan(
    inventory: DataFrame,
    catalog: DataFrame,
    remove_duplicates: bool = False,
    live_paths: DataFrame | None = None,
    extensions: Sequence[str] | None = None,
) -> DataFrame:
    """Action plan for cataloguing a folder in place.

    The files stay where they are. Duplicates are skipped, or removed if asked for and if the
    original is known to be there; the file a record points to is never its own duplicate. Files
    with other extensions are SKIPPED, files without a hash are an ERROR.
    """
    inventory = inventory.withColumn("reason", skip_reason(extensions or IMAGE_EXTENSIONS))
    files = inventory.where(F.col("reason").isNull() & F.col("hash").isNotNull())
    verdicts = content_verdicts(files, catalog, live_paths).withColumn("kept_target", F.col("kept_path"))
    duplicate = DELETE_DUPLICATE if remove_duplicates else SKIP_DUPLICATE
    known = F.col("state").isin("KNOWN", "UNSURE")
    action = (
        F.when(known & (F.col("path") == F.col("existing_path")), ALREADY_CATALOGUED)
        .when(F.col("state") == "UNSURE", SKIP_DUPLICATE)
        .when((F.col("state") == "KNOWN") | (F.col("path") != F.col("kept_path")), duplicate)
        .when(F.col("state") == "STALE", REPLACE_STALE)
        .otherwise(CATALOG_ACTION)
    )
    return _planned(inventory, files, verdicts, action)


def ingest_folder(
    spark: SparkSession, root: str, catalog: DataFrame, target_root: str, algorithm: str | None = None, **options
) -> DataFrame:
    """``plan_ingest`` of a folder, as a written table; contents are read and hashed once."""
    inventory = settle(file_inventory(spark, root, algorithm=algorithm), "inventory")
    return settle(plan_ingest(inventory, catalog, target_root, at=settle, **options), "plan")
