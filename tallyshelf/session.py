"""Where intermediate tables live, and how they are written.

Content hashing is the one expensive step of every flow, so its result is written
once as a narrow Parquet table and read back wherever several branches of a plan
need it. The table sits in the shared folder named by ``spark.checkpoint.dir``: any
executor may be lost and its tasks rerun, and nothing has to be hashed again.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    A session that names none gets a scratch folder if its master is known to be local; on a
    cluster that would be local to one machine, so it is refused.
    """
    configured = spark.conf.get(SHARED_DIR_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {SHARED_DIR_SETTING} to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="tallyshelf-")
    spark.conf.set(SHARED_DIR_SETTING, scratch)
    return scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def unsettled(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself: what a plan does at its named points unless the caller has it ``settle`` there."""
    return df


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it as a Parquet scan, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
