"""One query per operator; each takes a session and the folder of the given tables."""

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf import functions as fn
from tallyshelf.operators import catalog as cat
from tallyshelf.operators import dedup, filters, loglines, matching, naming, stats
from tallyshelf.plans import analyze_log, apply_plan, catalog_statistics, plan_ingest, plan_scan
from tallyshelf.plans.catalogs import new_records
from tallyshelf.schemas import CATALOG
from tallyshelf.session import scratch_path, settle
from tallyshelf.sources import catalog_index as indexed
from tallyshelf.sources import catalog_store, logs, sinks
from tallyshelf.sources import files as folder
from tallyshelf.streaming import events as bursts
from tallyshelf.streaming import ingest as streamed
from tallyshelf.streaming import buffers, progress, tries, watch

from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
FILE = ["path", "name", "extension", "file_size", "modified_at", "hash", "hash_type"]
RECORD = CATALOG.names
WANTED = {"extensions": ["en", "fr", "de", "es"]}
LIMITED = {"extensions": ["en", "fr"], "max_size": 4096}


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


# Filters and projections


def on_files(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf: operator(t.files(spark, sf), *args).select(*FILE)


def on_messy(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: operator(t.messy_files(spark, sf)).select("doc_id", "name")


def on_catalog(operator: Callable[..., DataFrame], *args, **options) -> Query:
    return lambda spark, sf: operator(t.catalog(spark, sf), *args, **options)


def catalog_rows(mode: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = t.files(spark, sf).withColumn("target_path", fn.join_path(F.lit(t.TODAY), F.col("name")))
        return cat.to_catalog_rows(rows, mode, t.PROCESSED_AT)

    return query


def file_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = t.settled_catalog(spark, sf)
    return filters.file_by_hash(records, records.agg(F.max("hash")).scalar())


# Joins


def matched(operator: Callable[..., DataFrame], *more: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        inventory = t.settled_files(spark, sf)
        return operator(inventory, t.catalog(spark, sf, inventory)).select(*FILE, *more)

    return query


def stale_records(spark: SparkSession, sf: str) -> DataFrame:
    records, live = t.settled_catalog(spark, sf)
    return matching.stale_records(records, live).select("id", "hash", "existing_path")


def lost_hashes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records, live = t.settled_catalog(spark, sf)
    return records, matching.stale_records(records, live).select("hash")


def delete_records(spark: SparkSession, sf: str) -> DataFrame:
    return cat.delete_records(*lost_hashes(spark, sf)).select(*RECORD)


def deletion_report(spark: SparkSession, sf: str) -> DataFrame:
    return cat.deletion_report(t.catalog(spark, sf), t.files(spark, sf))


def taken_names(spark: SparkSession, sf: str) -> DataFrame:
    wanted = t.files(spark, sf).select("path", "name", F.lit(t.TODAY).alias("target_dir"))
    return matching.taken_names(wanted, t.today_names(t.catalog(spark, sf))).select("path", "name")


def merge_catalog(spark: SparkSession, sf: str) -> DataFrame:
    records, lost = lost_hashes(spark, sf)
    return cat.merge_catalog(records.join(lost, "hash", "left_anti"), records.join(lost, "hash", "left_semi")).select(*RECORD)


def resolve_name_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    inventory = t.settled_files(spark, sf)
    arriving = inventory.withColumn("target_dir", F.lit(t.TODAY))
    named = naming.resolve_name_conflicts(arriving, t.today_names(t.catalog(spark, sf, inventory)), at=settle)
    return named.select("path", "name", "final_name")


def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(t.settled_files(spark, sf)).select(*FILE, "kept_path", "copies", "is_duplicate")


def keep_last(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(t.dirty_catalog(spark, sf)).select("id", "hash", F.col("source_path").alias("path"))


# Plans


def ingest_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Action plan of ingesting all files, the catalog it is for, and the live library paths."""
    inventory = t.settled_files(spark, sf)
    records, live = t.settled_catalog(spark, sf, inventory)
    plan = plan_ingest(
        inventory, records, t.LIBRARY, t.PROCESSED_AT, live_paths=live, taken=t.today_names(records), at=settle, **WANTED
    )
    return plan, records, live


def ingest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_inputs(spark, sf)[0]


def plan_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A plan with limits given by the caller, over an inventory in which every 50th file was not readable."""
    readable = F.when(F.col("doc_id") % 50 != 0, F.col("hash"))
    inventory = settle(t.files(spark, sf).withColumn("hash", readable), "files")
    records, live = t.settled_catalog(spark, sf)
    return plan_ingest(inventory, records, t.LIBRARY, t.PROCESSED_AT, live_paths=live, taken=t.today_names(records), **LIMITED)


def crowded_names(spark: SparkSession, sf: str) -> DataFrame:
    """All documents want one name in a folder that holds some suffixed forms of it."""
    inventory = t.settled_files(spark, sf).select("path", F.lit("IMG.jpg").alias("name"), F.lit(t.TODAY).alias("target_dir"))
    taken = t.table(spark, sf, "documents").where("doc_id % 2 = 1").select(
        F.lit(t.TODAY).alias("target_dir"), F.concat(F.lit("IMG_"), F.col("doc_id") * 3, F.lit(".jpg")).alias("name")
    )
    return naming.resolve_name_conflicts(inventory, taken).select("path", "final_name")


def over_plan(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: operator(ingest(spark, sf))


def scan(remove_duplicates: bool) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        pictures, records = settle(t.image_files(spark, sf), "pictures"), t.scan_catalog(spark, sf)
        nothing_else = pictures.select("path").limit(0)
        return plan_scan(pictures, records, remove_duplicates, live_paths=nothing_else)

    return query


def applied(spark: SparkSession, sf: str) -> DataFrame:
    plan, records, _ = ingest_inputs(spark, sf)
    return apply_plan(settle(plan, "plan"), records, "ingest", t.PROCESSED_AT).select(*RECORD)


def replaced(spark: SparkSession, sf: str) -> DataFrame:
    """As ``apply_plan``, through the operator on records."""
    plan, records, _ = ingest_inputs(spark, sf)
    return cat.replace_stale(records, new_records(settle(plan, "plan"), records, "ingest", t.PROCESSED_AT)).select(*RECORD)


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    rates = stats.throughput(t.files(spark, sf), time="modified_at")
    return rounded(rates, files_per_second=6, bytes_per_second=6)


def worker_load(spark: SparkSession, sf: str) -> DataFrame:
    samples = t.table(spark, sf, "events").selectExpr(
        "user_id as worker_id", "cast(round(value * 1000000) as bigint) as load_ns"
    )
    return stats.worker_load(samples)


# Sources and sinks


def written_tree(spark: SparkSession, sf: str, below: Column | str = "") -> str:
    """Document texts as files of one line, a thousand of them in a folder. One for each file would take as much disk as it."""
    root, below = scratch_path(spark, "tree"), F.lit(below) if isinstance(below, str) else below
    path = F.concat(below, F.expr("concat(doc_id div 1000, '/doc_id=', doc_id, '.txt')"))
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    sinks.write_files(t.table(spark, sf, "documents").select(path.alias("path"), line.alias("content")), root)
    return root


def by_document(inventory: DataFrame, *columns: str) -> DataFrame:
    """Files by the document they were written from, as their names are up to the writer."""
    document = F.regexp_extract("path", r"doc_id=([0-9]*)\.", 1).cast("bigint")
    return inventory.select(document.alias("doc_id"), *columns)


CONTENT = ["extension", "file_size", "hash", "hash_type"]


def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return by_document(folder.file_inventory(spark, written_tree(spark, sf), extensions=["TXT"]), *CONTENT)


def new_file_stream(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    stream = folder.hashed(folder.new_file_stream(spark, written_tree(spark, sf), extensions=["txt"]))
    bursts.start_append(stream, out, scratch_path(spark, "progress")).awaitTermination()
    return by_document(spark.read.schema(stream.schema).parquet(out), *CONTENT)


def quarantine_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Listed files that vanish before they are read: a seventh before the first batch, another before the third."""
    kind = F.when(F.col("doc_id") % 7 == 0, "lost").when(F.col("doc_id") % 7 == 1, "late").otherwise("good")
    tree, root = written_tree(spark, sf, F.concat(F.lit("kind="), kind, F.lit("/"))), scratch_path(spark, "ledger")
    listing = settle(folder.file_listing(spark, tree), "listing")
    is_late = F.col("path").contains("/kind=late/")
    for batch, new in enumerate((listing.where(~is_late), listing.limit(0), listing.where(is_late))):
        if batch != 1:
            gone = f"{tree}/kind={'late' if batch else 'lost'}"
            spark.createDataFrame([], "text string").write.mode("overwrite").text(gone)
        offered = tries.offered(new, root, batch)
        tries.try_files(offered, folder.file_inventory(spark, tree), root, batch)
    given_up = by_document(tries.errors(spark, root), "extension", "file_size", "hash", "action", "reason", "tries")
    open_ = tries.tries(spark, root).where(F.col("tries") < tries.MOST_TRIES)
    open_ = open_.withColumns({"hash": F.lit(None).cast("string"), "action": F.lit("RETRY")})
    return given_up.unionByName(by_document(open_, "extension", "file_size", "hash", "action", "reason", "tries"))


def read_catalog(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "catalog")
    catalog_store.write_snapshot(t.catalog(spark, sf), root, 1)
    return catalog_store.read_catalog(spark, root)


def catalog_index(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the contents of badly labelled documents, looked up in ten indexed segments."""
    root = scratch_path(spark, "indexed")
    whole = settle(cat.compact_catalog(t.dirty_catalog(spark, sf)), "compact")
    for batch in range(10):
        catalog_store.append_catalog(whole.where(F.col("id") % 10 == batch), root, batch)
    wanted = t.files(spark, sf).join(t.table(spark, sf, "labels").where("quality = 0"), "doc_id").select("hash")
    return indexed.find_records(spark, root, settle(wanted, "wanted")).select(*RECORD)


def stored_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """A stored catalog after deletes and replacements: as segments, folded, and looked up by the index once folded.

    The contents of badly labelled documents are deleted; every seventh record is replaced, deleted or not.
    """
    root = scratch_path(spark, "stored")
    whole = settle(cat.compact_catalog(t.dirty_catalog(spark, sf)), "compact")
    for batch in range(8):
        catalog_store.append_catalog(whole.where(F.col("id") % 8 == batch), root, batch)
    wanted = settle(t.files(spark, sf).join(t.table(spark, sf, "labels").where("quality = 0"), "doc_id").select("hash"), "wanted")
    added = settle(whole.where("id % 7 = 0").withColumn("id", F.col("id") + 1_000_000_000), "replaced")
    for _ in range(2):
        catalog_store.delete_stored(wanted, root, 8)
        catalog_store.append_catalog(whole.where("false"), root, 8)
        catalog_store.replace_stored(added, root, 9)
    states = {"segments": settle(catalog_store.read_segments(spark, root), "segments")}
    catalog_store.fold_segments(spark, root, before=10, fan=4)
    states |= {"folded": catalog_store.read_segments(spark, root), "found": indexed.find_records(spark, root, wanted)}
    return reduce(DataFrame.unionByName, (rows.select(F.lit(n).alias("state"), *RECORD) for n, rows in states.items()))


def append_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a folder added to a stored catalog, twice, as after a replay."""
    root = scratch_path(spark, "segments")
    inventory = t.settled_files(spark, sf)
    records, _ = t.settled_catalog(spark, sf, inventory)
    catalog_store.init_segments(spark, root, records)
    stored = catalog_store.read_segments(spark, root, before=0)
    plan = plan_ingest(
        inventory, stored, t.LIBRARY, t.PROCESSED_AT, taken=t.today_names(stored), **WANTED
    )
    added = settle(new_records(settle(plan, "plan"), stored, "ingest", t.PROCESSED_AT), "added")
    for _ in range(2):
        catalog_store.append_catalog(added, root, 0)
    return catalog_store.read_segments(spark, root).select(*RECORD)


def read_log(spark: SparkSession, sf: str) -> DataFrame:
    return loglines.log_events(t.log_lines(spark, sf)).groupBy("level").agg(F.count("*").alias("lines"))


def write_action_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan, path = ingest(spark, sf), scratch_path(spark, "plan")
    sinks.write_action_plan(plan, path)
    return spark.read.schema(plan.schema).parquet(path)


def write_library(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "library")
    contents = t.table(spark, sf, "documents").selectExpr(
        "concat('/src/', source, '/', doc_id div 100, '/doc_', doc_id % 100, '.', upper(lang)) as path",
        "cast(text as binary) as content",
    )
    plan = settle(ingest(spark, sf), "plan")
    for _ in range(2):  # as after a failure
        sinks.write_library(sinks.with_content(plan, contents), root, 7)
    schema = "path string, content binary, target_path string, batch int, year string, month string, day string"
    return spark.read.schema(schema).parquet(root).select(
        "target_path", fn.sha256_hex("content").alias("hash"), F.length("content").cast("bigint").alias("file_size"),
        "year", "month", "day",
    )


def write_report(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "report")
    sinks.write_reports(analyze_log(t.log_lines(spark, sf)), root)

    def read(name: str, schema: str, n: str, value: str) -> DataFrame:
        rows = spark.read.schema(schema).json(f"{root}/{name}")
        columns = [F.lit(name).alias("report"), F.expr(n).cast("bigint").alias("n"), F.expr(value).cast("double").alias("value")]
        return rows.select(F.col("operation") if "operation" in schema else F.lit(None).cast("string").alias("operation"), *columns)

    parts = [
        read("latency", "operation string, count bigint, median_ms double", "count", "round(median_ms, 6)"),
        read("transfer", "operation string, avg_speed_mbps double", "null", "round(avg_speed_mbps, 6)"),
        read("top_by_total_time", "operation string, count bigint, total_ms double", "count", "round(total_ms, 3)"),
        read("top_by_avg_time", "operation string, count bigint, avg_ms double", "count", "round(avg_ms, 6)"),
        read("warning_count", "warnings bigint", "warnings", "null"),
        read("first_warnings", "ts timestamp_ntz, file_name string", "1", "null"),
    ]
    return reduce(DataFrame.unionByName, parts)


# Log analytics


def over_lines(operator: Callable[..., DataFrame], *columns: str | Column, **options) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = operator(t.log_lines(spark, sf), **options)
        return found.select(*columns) if columns else found

    return query


def samples(strict: bool = False, extra: bool = False) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = loglines.classify_operations(t.log_lines(spark, sf), strict, extra).drop("line")
        return rounded(found, time_ms=6)

    return query


def over_samples(operator: Callable[[DataFrame], DataFrame], **places: int) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(operator(loglines.classify_operations(t.log_lines(spark, sf))), **places)

    return query


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = settle(loglines.classify_operations(t.log_lines(spark, sf)).select("operation", "time_ms"), "samples")
    return rounded(stats.latency_stats(found), avg_ms=6, median_ms=6, min_ms=6, max_ms=6, stddev_ms=4)


def operation_names(spark: SparkSession, sf: str) -> DataFrame:
    found = loglines.classify_operations(t.log_lines(spark, sf), extra=True)
    counted = found.groupBy("operation").agg(F.count("*").alias("samples"))
    return loglines.operation_names(counted).select("operation", "name", "samples")


def performance_report(spark: SparkSession, sf: str) -> DataFrame:
    report = stats.performance_report(loglines.classify_operations(t.log_lines(spark, sf)))
    entries = report.select(F.explode("operations").alias("operation", "stats")).select("operation", "stats.*")
    return rounded(entries, avg_ms=6)


#: Rules by which the choice of advice is tested.
ADVICE = loglines.Advice(
    top={"detail": ["one", "two"], "total": ["three"], "file": ["four"], "o": ["five"]}, always=["six", "seven"], warned=["eight"]
)


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    lines = t.log_lines(spark, sf)
    return loglines.recommendations(loglines.classify_operations(lines), lines, advice=ADVICE)


def log_report(spark: SparkSession, sf: str) -> DataFrame:
    latency = analyze_log(t.log_lines(spark, sf))["latency"]
    return rounded(latency, avg_ms=6, median_ms=6, min_ms=6, max_ms=6, stddev_ms=4)


def log_fields(**values: Callable[[], Column]) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = loglines.log_events(t.log_lines(spark, sf))
        return found.select("ts", *(v().alias(k) for k, v in values.items()))

    return query


def filter_log_level(spark: SparkSession, sf: str) -> DataFrame:
    return filters.filter_log_level(loglines.log_events(t.log_lines(spark, sf)), "warning").select("ts", "level")


def queue_warnings(spark: SparkSession, sf: str) -> DataFrame:
    found = loglines.queue_warnings(t.log_lines(spark, sf))
    return found.select(
        fn.parse_log_line("value")["ts"].alias("ts"), fn.skipped_file_name("value").alias("file_name")
    )


def slow_operations(spark: SparkSession, sf: str) -> DataFrame:
    found = loglines.classify_operations(t.log_lines(spark, sf), extra=True)
    return rounded(loglines.slow_operations(found).select("operation", "time_ms"), time_ms=6)


# Streams


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = t.table(spark, sf, "events").schema
    return t.as_file_events(logs.file_event_stream(spark, f"{sf}/events.parquet*", "parquet", schema))


def all_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of all events, as a table."""
    return bursts.debounce_events(t.as_file_events(t.table(spark, sf, "events")), "30 minutes", "10 minutes")


def run_events(flow: Callable[[DataFrame], DataFrame]) -> Query:
    """Work off all events as a stream and read back what it wrote."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        out, stream = scratch_path(spark, "stream"), flow(event_stream(spark, sf))
        bursts.start_append(stream, out, scratch_path(spark, "progress")).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    return query


PARTS = 10
CLOSING = "/closing.jpg"


def dealt(rows: DataFrame, part: Column) -> DataFrame:
    """The rows written once, a folder for each ``part``, so that taking one part reads that part alone."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "parts")
    rows.withColumn("part", part.cast("int")).write.partitionBy("part").parquet(path)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, part int").parquet(path)


def in_parts(rows: DataFrame, part: Column, closing: dict[str, str], run: Callable[[DataFrame], object]) -> None:
    """Let a stream take the rows in micro-batches, and last a closing event a day after all others.

    Every part is a run of its own that goes on from the checkpoint of the one before.
    """
    spark, arriving = rows.sparkSession, scratch_path(rows.sparkSession, "arriving")
    table = dealt(rows, part)
    last = table.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    last = last.select(*(F.expr(closing.get(f.name, f"cast(null as {f.dataType.simpleString()})")).alias(f.name) for f in rows.schema.fields))
    for k in range(PARTS + 1):
        chosen = last if k == PARTS else table.where(F.col("part") == k).drop("part")
        chosen.write.mode("append").parquet(arriving)
        run(spark.readStream.schema(rows.schema).parquet(arriving)).awaitTermination()


def numbered_events(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """File events with their numbers, and which tenth of all events each is in."""
    events = t.table(spark, sf, "events")
    rows = t.as_file_events(events, "event_id")
    return rows, F.floor(F.col("event_id") * PARTS / F.lit(max(1, events.count())))


def written_stream(flow: Callable[[DataFrame], DataFrame], out: str, progress_: str) -> Callable[[DataFrame], object]:
    return lambda stream: bursts.start_append(flow(stream), out, progress_)


def debounce_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All bursts, from a stream in ten parts; the closing event lets the last ones go."""
    out, rows = scratch_path(spark, "stream"), numbered_events(spark, sf)
    flow = lambda e: bursts.debounce_events(e, "30 minutes", "10 minutes")
    in_parts(*rows, {"path": f"'{CLOSING}'", "op": "'CREATE'", "ts": "ts"}, written_stream(flow, out, scratch_path(spark, "progress")))
    return spark.read.schema(all_bursts(spark, sf).schema).parquet(out)


def late_event_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth event comes three parts late. Bursts of the others, and the late events with the watermark they missed."""
    rows, part = numbered_events(spark, sf)
    part = F.least(F.lit(PARTS - 1), part + F.when(F.col("event_id") % 50 == 0, 3).otherwise(0))
    names = ("bursts", "judged")
    out, places = ({n: scratch_path(spark, f"{kind}-{n}") for n in names} for kind in ("stream", "progress"))
    gap, delay = "30 minutes", "10 minutes"
    schema = "path string, op string, ts timestamp, watermark timestamp"

    def run(stream: DataFrame) -> object:
        judged = watch.judge_events(stream.select("path", "op", "ts"), gap, delay)
        bursts.start_append(judged, out["judged"], places["judged"]).awaitTermination()
        timely = spark.readStream.schema(schema).parquet(out["judged"]).where("watermark is null").drop("watermark")
        return bursts.start_append(bursts.debounce_events(timely, gap, delay), out["bursts"], places["bursts"])

    in_parts(rows, part, {"path": f"'{CLOSING}'", "op": "'CREATE'", "ts": "ts"}, run)
    kept = spark.read.schema(all_bursts(spark, sf).schema).parquet(out["bursts"]).withColumn("watermark", F.lit(None).cast("timestamp_ntz"))
    late = spark.read.schema(schema).parquet(out["judged"]).where("watermark is not null")
    ts = F.col("ts").cast("timestamp_ntz")
    late = late.select(
        "path", F.lit(0).cast("bigint").alias("events"), ts.alias("first_ts"), ts.alias("last_ts"), F.col("op").alias("last_op"),
        F.col("watermark").cast("timestamp_ntz").alias("watermark"),
    )
    return kept.unionByName(late)


def flush_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Flushes of a buffer that all events pass: fifty rows, or what there is after ten minutes of quiet."""
    out, (rows, part) = scratch_path(spark, "stream"), numbered_events(spark, sf)
    flow = lambda e: buffers.flush_buffer(e, limit=streamed.FLUSH_FILES, quiet="10 minutes", delay="1 minute")
    in_parts(rows, part, {"ts": "ts"}, written_stream(flow, out, scratch_path(spark, "progress")))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, shard bigint, flush bigint, reason string"
    flushed = spark.read.schema(schema).parquet(out).groupBy("flush", "reason")
    times = [f("ts").cast("timestamp_ntz").alias(n) for f, n in ((F.min, "first_ts"), (F.max, "last_ts"))]
    return flushed.agg(F.count("*").alias("rows"), *times)


def watch_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as files, a third of them in three writes, and a tenth is removed again; files let through, and contents recorded."""
    roots = [scratch_path(spark, name) for name in ("segments", "plans")]
    catalog_store.init_segments(spark, roots[0])
    found = settle(t.as_files(t.table(spark, sf, "documents"), "concat('doc_', doc_id, '.EN')"), "files")
    step = lambda op, seconds, share: F.struct(F.lit(op).alias("op"), F.lit(seconds).alias("after"), F.lit(share).alias("share"))
    grows = F.array(step("CREATE", 0.0, 1), step("WRITE", 1.5, 2), step("WRITE", 3.0, 3))
    steps = F.when(F.col("doc_id") % 3 == 0, grows).otherwise(F.array(step("CREATE", 0.0, 2), step("WRITE", 2.0, 3)))
    steps = F.when(F.col("doc_id") % 10 == 7, F.concat(steps, F.array(step("REMOVE", 4.0, 3)))).otherwise(steps)
    events = found.select("doc_id", "path", "file_size", "modified_at", F.inline(steps)).select(
        "path", "op", F.timestamp_millis((F.lit(1704067200000) + F.col("doc_id") * 1000 + F.col("after") * 1000).cast("bigint")).alias("ts"),
        F.floor(F.col("file_size") * F.col("share") / 3).alias("file_size"), "modified_at",
    )
    documents = found.agg(F.max("doc_id")).first()[0] or 0
    part = F.least(F.lit(PARTS - 1), F.floor((F.unix_millis("ts") - F.lit(1704067200000)) / F.lit(1000.0 * (documents + 5) / PARTS)))
    inventory = found.drop("doc_id")
    run = partial(
        watch.watch_ingest, catalog_root=roots[0], plan_root=roots[1], target_root=t.LIBRARY, checkpoint=scratch_path(spark, "progress"),
        read=lambda quiet: inventory.join(quiet.select("path"), "path", "left_semi"), processed_at=t.PROCESSED_AT, **WANTED,
    )
    in_parts(events, part, {"path": f"'{CLOSING}'", "op": "'CREATE'", "ts": "ts"}, run)
    plans = spark.read.schema("path string, hash string").parquet(roots[1]).select(F.lit("let through").alias("what"), "path", "hash")
    records = catalog_store.read_segments(spark, roots[0]).select(F.lit("recorded").alias("what"), F.lit(None).cast("string").alias("path"), "hash")
    return plans.unionByName(records)


def plain_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run_ingest(start: Callable[..., object]) -> Query:
    """Ingest all documents as a stream of files; gives the catalog afterwards."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        roots = [scratch_path(spark, name) for name in ("segments", "plans")]
        records, _ = t.settled_catalog(spark, sf)
        catalog_store.init_segments(spark, roots[0], records)
        schema = t.table(spark, sf, "documents").schema
        incoming = t.as_files(spark.readStream.schema(schema).parquet(f"{sf}/documents.parquet*"))
        running = start(
            incoming, *roots, t.LIBRARY, scratch_path(spark, "progress"), processed_at=t.PROCESSED_AT, **WANTED
        )
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        return catalog_store.read_segments(spark, roots[0]).select(*RECORD)

    return query


def running_totals(spark: SparkSession, sf: str) -> DataFrame:
    plans, out = scratch_path(spark, "plan"), scratch_path(spark, "totals")
    plan = ingest(spark, sf)
    sinks.write_action_plan(plan, plans)
    stream = spark.readStream.schema(plan.schema).parquet(plans)
    progress.start_totals(stream, out, scratch_path(spark, "progress"), interval=None).awaitTermination()
    return progress.latest_totals(spark, out)


def running_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and rates of a plan that comes in ten micro-batches."""
    plans, out, place = (scratch_path(spark, name) for name in ("plan", "totals", "progress"))
    plan = dealt(ingest(spark, sf), F.pmod(F.xxhash64("path"), F.lit(PARTS)))
    for part in range(PARTS):
        plan.where(F.col("part") == part).drop("part").write.mode("append").parquet(plans)
        stream = spark.readStream.schema(plan.drop("part").schema).parquet(plans)
        progress.start_totals(stream, out, place, interval=None, at="modified_at").awaitTermination()
    return rounded(progress.latest_totals(spark, out), files_per_second=9, bytes_per_second=6)


# Scalar functions


def of_files(key: str, **values: Callable[[], Column]) -> Query:
    return lambda spark, sf: t.files(spark, sf).select(key, *(v().alias(k) for k, v in values.items()))


def of_table(name: str, key: str, **values: Callable[[], Column]) -> Query:
    return lambda spark, sf: t.table(spark, sf, name).select(key, *(v().alias(k) for k, v in values.items()))


def size_of(spark: SparkSession, sf: str) -> DataFrame:
    sizes = t.files(spark, sf).selectExpr("doc_id", "file_size * (doc_id + 1) * if(extension = '.fr', file_size, 1) as size")
    return sizes.select("doc_id", fn.format_file_size("size").alias("value"))


def skipped_file_name(spark: SparkSession, sf: str) -> DataFrame:
    found = loglines.queue_warnings(t.log_lines(spark, sf))
    return found.select(fn.parse_log_line("value")["ts"].alias("ts"), fn.skipped_file_name("value").alias("value"))


SCALARS: dict[str, Query] = {
    "sha256_hex": of_table("documents", "doc_id", value=lambda: fn.sha256_hex("text")),
    "md5_hex": of_table("documents", "doc_id", value=lambda: fn.md5_hex("text")),
    "content_hash": of_table(
        "documents", "doc_id", md5=lambda: fn.content_hash("text", "md5"), sha256=lambda: fn.content_hash("text", "SHA256"),
        default_hash=lambda: fn.content_hash("text"),
    ),
    "file_extension": of_files("path", value=lambda: fn.file_extension("path")),
    "normalize_extension": of_table(
        "documents", "doc_id", bare=lambda: fn.normalize_extension("lang"),
        dotted=lambda: fn.normalize_extension(F.concat(F.lit("."), F.upper("lang"))),
    ),
    "base_name": of_files("path", value=lambda: fn.base_name("path")),
    "name_stem": of_files("path", value=lambda: fn.name_stem("name")),
    "date_path": of_files("doc_id", value=lambda: fn.date_path("modified_at")),
    "join_path": of_files("doc_id", value=lambda: fn.join_path(F.lit(t.LIBRARY), fn.date_path("modified_at"), "name")),
    "suffixed_name": of_files("path", value=lambda: fn.suffixed_name("name", F.expr("doc_id div 100"))),
    "format_file_size": size_of,
    "transfer_speed": of_table(
        "events", "event_id", value=lambda: F.round(fn.transfer_speed(F.expr("user_id * 1000"), "value"), 6)
    ),
    "hash_prefix": of_files(
        "doc_id", short=lambda: fn.hash_prefix("hash"), longer=lambda: fn.hash_prefix("hash", 16), whole=lambda: fn.hash_prefix("hash", 64)
    ),
    "duration_ms": of_table("events", "event_id", value=lambda: F.round(fn.duration_ms(t.duration_text()), 6)),
    "size_mb": of_table("events", "event_id", value=lambda: fn.size_mb(t.size_text())),
    "round_to_second": of_table("events", "event_id", value=lambda: fn.round_to_second("value")),
    "skipped_file_name": skipped_file_name,
    "parse_log_line": log_fields(
        level=lambda: F.col("level"), caller_file=lambda: F.col("caller_file"), caller_line=lambda: F.col("caller_line")
    ),
    "log_level_rank": log_fields(level=lambda: F.col("level"), value=lambda: fn.log_level_rank("level")),
}

BATCH: dict[str, Query] = {
    "filter_supported": on_files(filters.filter_supported, ["EN", ".fr"]),
    "filter_images": lambda spark, sf: filters.filter_images(t.image_files(spark, sf)).select(*FILE),
    "filter_max_size": on_files(filters.filter_max_size, 1024),
    "filter_hidden": on_messy(filters.filter_hidden),
    "filter_temp": on_messy(filters.filter_temp),
    "filter_ready": on_files(filters.filter_ready, 4096),
    "file_by_hash": file_by_hash,
    "large_files": on_catalog(filters.large_files, 4096),
    "to_catalog_rows_ingest": catalog_rows("ingest"),
    "to_catalog_rows_scan": catalog_rows("scan"),
    "existing_path": lambda spark, sf: cat.existing_path(t.catalog(spark, sf)).select("id", "existing_path"),
    "match_catalog": matched(matching.match_catalog, "catalog_id", "existing_path", "known"),
    "known_files": matched(matching.known_files),
    "new_files": matched(matching.new_files),
    "stale_records": stale_records,
    "delete_records": delete_records,
    "deletion_report": deletion_report,
    "taken_names": taken_names,
    "merge_catalog": merge_catalog,
    "check_catalog": lambda spark, sf: cat.check_catalog(t.dirty_catalog(spark, sf)),
    "total_files": on_catalog(stats.total_files),
    "total_size": on_catalog(stats.total_size),
    "stats_by_extension": lambda spark, sf: stats.stats_by_extension(t.files(spark, sf)),
    "extensions_ranked": lambda spark, sf: stats.extensions_ranked(t.files(spark, sf)),
    "stats_by_size_tier": lambda spark, sf: stats.stats_by_size_tier(t.files(spark, sf), (1024, 4096)),
    "catalog_statistics": lambda spark, sf: catalog_statistics(t.files(spark, sf)),
    "files_by_extension": on_catalog(cat.files_by_extension, ".en", 20),
    "largest_files": on_catalog(cat.largest_files, 10),
    "largest_files_per_extension": on_catalog(cat.largest_files, 3, per_extension=True),
    "dedup_keep_first": on_files(dedup.dedup_keep_first),
    "dedup_keep_last": keep_last(dedup.dedup_keep_last),
    "compact_catalog": keep_last(cat.compact_catalog),
    "duplicate_groups": duplicate_groups,
    "resolve_name_conflicts": resolve_name_conflicts,
    "crowded_names": crowded_names,
    "plan_ingest": ingest,
    "plan_ingest_filtered": plan_filtered,
    "plan_scan": scan(remove_duplicates=True),
    "plan_scan_skip": scan(remove_duplicates=False),
    "apply_plan": applied,
    "replace_stale": replaced,
    "processing_stats": over_plan(stats.processing_stats),
    "scan_stats": lambda spark, sf: stats.scan_stats(scan(remove_duplicates=False)(spark, sf)),
    "outcome_percentages": over_plan(stats.outcome_percentages),
    "average_size": over_plan(stats.average_size),
    "throughput": throughput,
    "worker_load": worker_load,
}

STORES: dict[str, Query] = {
    "file_inventory": file_inventory,
    "read_catalog": read_catalog,
    "append_catalog": append_catalog,
    "catalog_index": catalog_index,
    "stored_deletes": stored_deletes,
    "read_log": read_log,
    "write_action_plan": write_action_plan,
    "write_library": write_library,
    "write_report": write_report,
}

LOGS: dict[str, Query] = {
    "classify_operations": samples(),
    "classify_operations_strict": samples(strict=True),
    "classify_operations_extra": samples(extra=True),
    "queue_warnings": queue_warnings,
    "warning_count": over_lines(loglines.warning_count),
    "first_warnings": over_lines(loglines.first_warnings, "ts", "file_name"),
    "filter_log_level": filter_log_level,
    "slow_operations": slow_operations,
    "worker_counts": over_lines(loglines.worker_counts),
    "latency_stats": latency_stats,
    "transfer_stats": over_samples(stats.transfer_stats, avg_speed_mbps=6, avg_size_mb=3),
    "operation_totals": over_samples(stats.operation_totals, total_ms=3, avg_ms=6),
    "performance_report": performance_report,
    "top_by_total_time": over_samples(stats.top_by_total_time, total_ms=3, avg_ms=6),
    "top_by_avg_time": over_samples(stats.top_by_avg_time, total_ms=3, avg_ms=6),
    "top_bottleneck": over_samples(stats.top_bottleneck, total_ms=3, avg_ms=6),
    "operation_names": operation_names,
    "recommendations": recommendations,
    "analyze_log": log_report,
}

STREAMS: dict[str, Query] = {
    "file_event_stream": run_events(plain_time),
    "filter_events": run_events(lambda events: plain_time(filters.filter_events(events))),
    "debounce_events": all_bursts,
    "debounce_stream": debounce_stream,
    "drop_vanished": lambda spark, sf: bursts.drop_vanished_events(all_bursts(spark, sf)),
    "late_event_policy": late_event_policy,
    "flush_sizes": flush_sizes,
    "watch_ingest": watch_ingest,
    "new_file_stream": new_file_stream,
    "ingest_stream": run_ingest(streamed.ingest_stream),
    "scheduled_ingest": run_ingest(partial(streamed.scheduled_ingest, interval="5 seconds")),
    "micro_batch_flush": run_ingest(streamed.micro_batch_flush),
    "quarantine_failures": quarantine_failures,
    "running_totals": running_totals,
    "running_rates": running_rates,
}


def in_utc(query: Query) -> Query:
    """Event times carry no zone; reading them as UTC keeps them what they are."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def queries() -> dict[str, Query]:
    return {name: in_utc(query) for name, query in (BATCH | STORES | LOGS | STREAMS | SCALARS).items()}
