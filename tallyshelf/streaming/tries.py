"""Files that cannot be read: a ledger of tries, and when to give up.

The ledger has one row per path and try, in a folder per batch. A batch that is replayed writes its folder
anew, so it counts once. Tries are those since a path was last read. A path that has failed fewer than
``most`` times is offered again with the next batch; one that has failed that often goes to the table of
errors with its reason, and is not offered any more until it is listed anew.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.files import PLAN_COLUMNS
from ..schemas import ERROR
from ..session import settle
from ..sources.catalog_parts import side_table

MOST_TRIES = 3
LISTED = "path string, name string, extension string, file_size bigint, modified_at timestamp_ntz"
LEDGER = f"{LISTED}, read boolean, reason string, batch bigint"


def ledger(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return side_table(spark, root, "tries", LEDGER, before)


def tries(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Per path that was not read last: its listing, the tries since it was last read, and the last reason."""
    rows = ledger(spark, root, before)
    newest = F.max(F.struct("batch", *(c.split()[0] for c in LISTED.split(", ")), "read", "reason")).alias("newest")
    read_at = F.coalesce(F.max(F.when(F.col("read"), F.col("batch"))), F.lit(-1)).alias("read_at")
    folded = rows.groupBy("path").agg(newest, read_at, F.collect_list(F.when(~F.col("read"), F.col("batch"))).alias("failed"))
    failed = F.size(F.array_distinct(F.filter("failed", lambda b: b > F.col("read_at"))))
    return folded.where(~F.col("newest.read")).select("newest.*", failed.alias("tries"))


def pending(spark: SparkSession, root: str, before: int | None = None, most: int = MOST_TRIES) -> DataFrame:
    """Listed files to be offered again."""
    return tries(spark, root, before).where(F.col("tries") < most).select(*(c.split()[0] for c in LISTED.split(", ")))


def errors(spark: SparkSession, root: str) -> DataFrame:
    """Plan rows of the files given up, with the number of tries and the batch of the last one."""
    text = ", ".join(f"{c} string" for c in ("hash", "hash_type", "action", "existing_path", "target_path", "reason"))
    return side_table(spark, root, "errors", f"{LISTED}, {text}, tries int, batch bigint", None)


def try_files(
    listing: DataFrame,
    read: DataFrame,
    root: str,
    batch: int,
    most: int = MOST_TRIES,
    reason: Column | str = "not readable",
) -> None:
    """Note which files of ``listing`` are in the inventory ``read``, and give up those that failed ``most`` times.

    ``listing`` has the new files and those of ``pending``; repeated rows are one try. ``reason`` may be a column of
    the listing.
    """
    spark = listing.sparkSession
    reason = F.lit(reason) if isinstance(reason, str) else reason
    names = [c.split()[0] for c in LISTED.split(", ")]
    found = read.where("hash is not null").select("path").distinct().withColumn("read", F.lit(True))
    tried = listing.select(*names, reason.alias("why")).dropDuplicates(["path"]).join(found, "path", "left")
    tried = tried.withColumn("read", F.coalesce("read", F.lit(False))).withColumn("reason", F.when(~F.col("read"), F.col("why")))
    # a path that was never in doubt needs no row
    doubted = ledger(spark, root, batch).select("path").distinct().withColumn("doubted", F.lit(True))
    tried = tried.join(doubted, "path", "left").where(~F.col("read") | F.col("doubted"))
    tried.select(*names, "read", "reason").write.mode("overwrite").parquet(f"{root}/tries/batch={batch}")
    text = F.lit(None).cast("string")
    given_up = tries(spark, root, batch + 1).where((F.col("batch") == batch) & (F.col("tries") >= most))
    rows = given_up.withColumns({c: text for c in ("hash", "hash_type", "existing_path", "target_path")}).withColumn("action", F.lit(ERROR))
    rows.select(*PLAN_COLUMNS, "tries").write.mode("overwrite").parquet(f"{root}/errors/batch={batch}")


def offered(listing: DataFrame, root: str, batch: int, most: int = MOST_TRIES) -> DataFrame:
    """The files to be tried with a batch: the new ones and the pending ones, as a written table."""
    names = [c.split()[0] for c in LISTED.split(", ")]
    new = listing.select(*names)
    return settle(new.unionByName(pending(listing.sparkSession, root, batch, most)).dropDuplicates(["path"]), "offered")
