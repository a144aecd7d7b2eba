"""Time the flows on many copies of the given inventory, one content holding a third of all rows.

Usage: python tools/scale.py [tables folder] [copies of the inventory]
"""

import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from shelfqueries import tables as t  # noqa: E402
from tallyshelf.operators.catalog import names_in_use  # noqa: E402
from tallyshelf.operators.dedup import duplicate_groups  # noqa: E402
from tallyshelf.operators.matching import known_files  # noqa: E402
from tallyshelf.operators.naming import assigned_names  # noqa: E402
from tallyshelf.plans import apply_plan, plan_ingest  # noqa: E402
from tallyshelf.session import settle  # noqa: E402


def timed(label, rows, run):
    start = time.time()
    result = run()
    took = time.time() - start
    print(f"{label:34} {took:7.1f}s {rows / took:12,.0f} files/s", flush=True)
    return result


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 200
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="scale-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    blank = F.col("copy") % 3 == 0
    inventory = (
        t.settled_files(spark, folder)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("path", F.concat(F.lit("/copy"), "copy", "path"))
        .withColumn("name", F.concat(F.lit("p"), F.xxhash64("path"), "extension"))
        .withColumn("path", F.concat_ws("/", F.regexp_replace("path", "/[^/]*$", ""), "name"))
        .withColumn("hash", F.when(blank, "blank").otherwise(F.sha2(F.concat("hash", F.col("copy")), 256)))
        .drop("copy", "doc_id")
    )
    files = settle(inventory, "inventory")
    rows = files.count()
    catalog, live = t.settled_catalog(spark, folder)
    print(rows, "files,", files.where("hash = 'blank'").count(), "of one content")
    timed("duplicate_groups", rows, lambda: noop(duplicate_groups(files)))
    timed("known_files", rows, lambda: noop(known_files(files, catalog)))
    plan = timed(
        "plan_ingest", rows,
        lambda: settle(
            plan_ingest(
                files, catalog, t.LIBRARY, t.PROCESSED_AT, ["en", "fr", "de", "es"], live_paths=live, taken=names_in_use(catalog)
            ),
            "plan",
        ),
    )
    after = timed("apply_plan", rows, lambda: settle(apply_plan(plan, catalog, "ingest", t.PROCESSED_AT), "catalog"))
    print("actions", {r.action: r["count"] for r in plan.groupBy("action").count().collect()}, "catalog", after.count())
    # Every file in one folder under one name, each content different: a third of the names are in use already.
    crowd = files.select(F.concat("path", F.xxhash64("path")).alias("path"), F.lit("IMG.jpg").alias("name"), F.lit(t.TODAY).alias("target_dir"))
    taken = spark.range(0, rows, 3).select(F.lit(t.TODAY).alias("target_dir"), F.concat(F.lit("IMG_"), "id", F.lit(".jpg")).alias("name"))
    timed("crowded names", rows, lambda: noop(assigned_names(crowd, taken)))


if __name__ == "__main__":
    main()
