"""Counts, sizes and rates over catalogs, action plans and worker samples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ALREADY_CATALOGUED, CATALOG_ACTION, DELETE_DUPLICATE, ERROR, MOVE, REPLACE_STALE, SKIP_DUPLICATE, SKIPPED

KEPT = [MOVE, CATALOG_ACTION, REPLACE_STALE]


def _sum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def total_files(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("total_files"))


def total_size(catalog: DataFrame) -> DataFrame:
    return catalog.agg(_sum("file_size").alias("total_size"))


def stats_by_extension(catalog: DataFrame) -> DataFrame:
    """Files and bytes per extension; an extension without any size counts zero bytes."""
    return catalog.groupBy("extension").agg(F.count("*").alias("count"), _sum("file_size").alias("size"))


def extensions_ranked(catalog: DataFrame) -> DataFrame:
    """``stats_by_extension``, most files first."""
    return stats_by_extension(catalog).orderBy(F.desc("count"), "extension")


def stats_by_size_tier(catalog: DataFrame, bounds: tuple[int, int] = (1 << 20, 10 << 20)) -> DataFrame:
    """Files and bytes below, between and above two sizes; the bounds belong to the middle tier."""
    small, large = bounds
    tier = F.when(F.col("file_size") < small, "small").when(F.col("file_size") <= large, "medium").otherwise("large")
    return catalog.groupBy(tier.alias("tier")).agg(F.count("*").alias("count"), _sum("file_size").alias("size"))


def catalog_statistics(catalog: DataFrame) -> DataFrame:
    """Files and bytes of each extension, and in all: the row whose extension is null and ``total`` true."""
    sums = [F.count("*").alias("count"), _sum("file_size").alias("size")]
    return catalog.rollup("extension").agg(F.grouping("extension").cast("boolean").alias("total"), *sums)


def _action(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def processing_stats(plan: DataFrame) -> DataFrame:
    """All, moved, deleted, skipped and failed files and the bytes of those moved or deleted."""
    done = F.when(_action(*KEPT, DELETE_DUPLICATE), F.col("file_size"))
    return plan.agg(
        F.count("*").alias("processed_files"),
        F.count_if(_action(*KEPT)).alias("moved_files"),
        F.count_if(_action(DELETE_DUPLICATE)).alias("deleted_files"),
        F.count_if(_action(SKIPPED, SKIP_DUPLICATE, ALREADY_CATALOGUED)).alias("skipped_files"),
        F.count_if(_action(ERROR)).alias("error_count"),
        _sum(done).alias("total_size"),
        _sum(F.when(_action(*KEPT), F.col("file_size"))).alias("moved_size"),
    )


def scan_stats(plan: DataFrame) -> DataFrame:
    """Processed, skipped, failed and deleted files of a scan, and their sum."""
    return plan.agg(
        F.count_if(_action(*KEPT)).alias("processed"),
        F.count_if(_action(SKIPPED, SKIP_DUPLICATE, ALREADY_CATALOGUED)).alias("skipped"),
        F.count_if(_action(ERROR)).alias("errors"),
        F.count_if(_action(DELETE_DUPLICATE)).alias("deleted"),
    ).withColumn("total", F.expr("processed + skipped + errors + deleted"))


def outcome_percentages(plan: DataFrame) -> DataFrame:
    """Share of moved, duplicate and failed files in percent, one decimal; null without files."""

    def percent(part: str) -> Column:
        return F.round(F.col(part) / F.nullif(F.col("processed_files"), F.lit(0)) * 100.0, 1)

    return processing_stats(plan).select(
        percent("moved_files").alias("moved_percent"),
        percent("deleted_files").alias("duplicate_percent"),
        percent("error_count").alias("error_percent"),
    )


def throughput(rows: DataFrame, time: str = "ts", size: str = "file_size") -> DataFrame:
    """Files and bytes per second between the first and the last time; null if no time passed."""
    timed = rows.select(F.col(time).cast("timestamp").alias("t"), F.col(size).alias("size"))
    totals = timed.agg(
        F.count("*").alias("files"),
        _sum("size").alias("bytes"),
        ((F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 1e6).alias("seconds"),
    )
    seconds = F.nullif(F.col("seconds"), F.lit(0.0))
    return totals.select(
        "files",
        "bytes",
        "seconds",
        (F.col("files") / seconds).alias("files_per_second"),
        (F.col("bytes") / seconds).alias("bytes_per_second"),
    )


def average_size(plan: DataFrame) -> DataFrame:
    """Bytes per moved file: as reported (all bytes handled) and of the moved files alone."""
    return processing_stats(plan).selectExpr(
        "total_size div nullif(moved_files, 0) as avg_size_reported",
        "moved_size div nullif(moved_files, 0) as avg_size_moved",
    )


def worker_load(samples: DataFrame) -> DataFrame:
    """Spread of load over workers from rows (worker_id, load_ns), one per processed file."""
    per_worker = samples.groupBy("worker_id").agg(F.sum("load_ns").alias("load"), F.count("*").alias("n"))
    return per_worker.agg(
        F.count("*").alias("workers"),
        F.sum("load").alias("total_load_ns"),
        F.expr("sum(load) div count(*)").alias("avg_load_ns"),
        F.min("load").alias("min_load_ns"),
        F.max("load").alias("max_load_ns"),
        F.expr("sum(load) div sum(n)").alias("avg_file_ns"),
    )


def operation_totals(samples: DataFrame) -> DataFrame:
    """Summed and mean time and number of samples per operation."""
    return samples.groupBy("operation").agg(
        F.sum("time_ms").alias("total_ms"), F.avg("time_ms").alias("avg_ms"), F.count("*").alias("count")
    )


def performance_report(samples: DataFrame) -> DataFrame:
    """``operation_totals`` as one map keyed by operation."""
    entries = F.struct("operation", F.struct("avg_ms", "count").alias("stats"))
    return operation_totals(samples).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entries))).alias("operations")
    )


def transfer_stats(samples: DataFrame) -> DataFrame:
    """Mean speed and size of the two operations that log them."""
    detailed = samples.where(F.col("operation").isin("file_copy_detail", "hash_calculation_detail"))
    return detailed.groupBy("operation").agg(
        F.avg("speed_mbps").alias("avg_speed_mbps"), F.avg("size_mb").alias("avg_size_mb")
    )


def top_by_total_time(samples: DataFrame, k: int = 10) -> DataFrame:
    return operation_totals(samples).orderBy(F.desc("total_ms"), "operation").limit(k)


def top_by_avg_time(samples: DataFrame, k: int = 10) -> DataFrame:
    return operation_totals(samples).orderBy(F.desc("avg_ms"), "operation").limit(k)


def top_bottleneck(samples: DataFrame) -> DataFrame:
    """The operation that took the most time altogether."""
    return top_by_total_time(samples, 1)


STEPS_PER_DOUBLING = 1024


def exact_median(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median per group without bringing a group together in one task.

    Equal values are counted first. A histogram with steps of under a tenth of a percent then
    tells which step holds the middle; its size is fixed by the range of the numbers, not by
    their amount. Only the values inside that step are put in order. Groups are meant to be
    few, as operations are: at most two histogram rows of each are broadcast.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    step = F.when(F.col("v") > 0, F.floor(F.log2("v") * STEPS_PER_DOUBLING)).otherwise(F.lit(-(1 << 40)))
    counts = counts.withColumn("step", step.cast("bigint"))
    upto = Window.partitionBy(group).orderBy("step")
    histogram = (
        counts.groupBy(group, "step")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    )
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = histogram.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(
        group, "step", (F.col("upto") - F.col("n")).alias("before"), low.alias("low"), high.alias("high")
    )
    running = Window.partitionBy(group, "step").orderBy("v")
    placed = (
        counts.join(middle, [group, "step"])
        .withColumn("last", F.col("before") + F.sum("n").over(running))
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    lower = F.max(F.when(F.col("low").between(F.col("first"), F.col("last")), F.col("v")))
    upper = F.max(F.when(F.col("high").between(F.col("first"), F.col("last")), F.col("v")))
    return placed.groupBy(group).agg(((lower + upper) / 2.0).alias("median"))


def latency_stats(samples: DataFrame) -> DataFrame:
    """Number, mean, median, extremes and sample deviation of the times of each operation."""
    simple = samples.groupBy("operation").agg(
        F.count("*").alias("count"),
        F.avg("time_ms").alias("avg_ms"),
        F.min("time_ms").alias("min_ms"),
        F.max("time_ms").alias("max_ms"),
        F.stddev_samp("time_ms").alias("stddev_ms"),
    )
    median = exact_median(samples, "operation", "time_ms").withColumnRenamed("median", "median_ms")
    return simple.join(median, "operation", "left").select(
        "operation", "count", "avg_ms", "median_ms", "min_ms", "max_ms", "stddev_ms"
    )
