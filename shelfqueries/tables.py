"""The given tables seen as files, a catalog, file events and a log.

One document is one file, and its text the content. Documents with a label are in the
catalog already; a label of good quality means the catalogued file is still in the library.
Names repeat across folders, and library names look like suffixed ones, so that names
conflict. One event is one file event, and one line of a log.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.functions import file_extension, sha256_hex
from tallyshelf.operators.catalog import existing_path_column, names_in_use
from tallyshelf.operators.loglines import EXTRA_OPERATIONS, OPERATIONS
from tallyshelf.schemas import CATALOG
from tallyshelf.session import scratch_path, settle
from tallyshelf.sources.logs import read_log

PROCESSED_AT = "2024-06-01 12:00:00"
LIBRARY = "/library"
TODAY = "/library/2024/06/01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_files(documents: DataFrame, name: str = "concat('doc_', doc_id % 100, '.', upper(lang))") -> DataFrame:
    """Inventory of documents, in batch or on a stream."""
    return documents.selectExpr(
        "doc_id",
        f"concat('/src/', source, '/', doc_id div 100, '/', {name}) as path",
        f"{name} as name",
        "cast(octet_length(text) as bigint) as file_size",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0) as modified_at",
        "text",
    ).select(
        "doc_id", "path", "name", file_extension("path").alias("extension"), "file_size", "modified_at",
        sha256_hex("text").alias("hash"), F.lit("sha256").alias("hash_type"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return as_files(table(spark, sf, "documents"))


def settled_files(spark: SparkSession, sf: str) -> DataFrame:
    """The inventory as a written table, for plans that read it more than once."""
    return settle(files(spark, sf), "files")


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pictures of several kinds, and some as text."""
    kind = "case lang when 'en' then 'JPG' when 'fr' then 'png' when 'de' then 'CR2' else 'txt' end"
    return as_files(table(spark, sf, "documents"), f"concat('doc_', doc_id % 100, '.', {kind})")


def messy_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under the names of hidden, temporary and partial files."""
    name = (
        "concat(case lang when 'fr' then '.' when 'de' then '~' else '' end, 'doc_', doc_id % 100,"
        " case when lang = 'es' then '.tmp' when source = 'src1' then '.part2.zip' else '.EN' end)"
    )
    return as_files(table(spark, sf, "documents"), name)


def labelled(spark: SparkSession, sf: str, inventory: DataFrame | None = None) -> DataFrame:
    """First labelled document of each content, with its labels."""
    known = (files(spark, sf) if inventory is None else inventory).join(table(spark, sf, "labels"), "doc_id")
    first = F.row_number().over(Window.partitionBy("hash").orderBy("doc_id"))
    return known.withColumn("place", first).where("place = 1")


def with_records(known: DataFrame) -> DataFrame:
    """Catalog records and the labels they came with."""
    library_name = (
        "case when doc_id div 100 = 0 then name"
        " else concat('doc_', doc_id % 100, '_', doc_id div 100, '.', substring_index(name, '.', -1)) end"
    )
    return known.selectExpr(
        "doc_id + 1 as id", "hash", "name as original_name", "file_size", "extension", "modified_at as created_at",
        "modified_at + interval 1 day as processed_at", "path as source_path",
        f"case when toxic = 1 and quality = 1 then '' when toxic = 1 then null"
        f" else concat('{TODAY}/', {library_name}) end as target_path",
        "hash_type", "quality", "toxic",
    )


def catalog(spark: SparkSession, sf: str, inventory: DataFrame | None = None) -> DataFrame:
    return with_records(labelled(spark, sf, inventory)).select(*CATALOG.names)


def settled_catalog(
    spark: SparkSession, sf: str, inventory: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The catalog as a written table, and the paths of its files that are still there."""
    records = settle(with_records(labelled(spark, sf, inventory)), "catalog")
    live = records.where("quality = 1").select(existing_path_column().alias("path"))
    return records.select(*CATALOG.names), live


def scan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog of pictures scanned in place; those marked toxic have been moved since."""
    known = image_files(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    first = F.row_number().over(Window.partitionBy("hash").orderBy("doc_id"))
    moved = F.when(F.col("toxic") == 1, F.concat(F.lit("/old"), F.col("path"))).otherwise(F.col("path"))
    return known.withColumn("place", first).where("place = 1").select(
        (F.col("doc_id") + 1).alias("id"), "hash", F.col("name").alias("original_name"), "file_size", "extension",
        F.col("modified_at").alias("created_at"), F.col("modified_at").alias("processed_at"),
        moved.alias("source_path"), moved.alias("target_path"), "hash_type",
    )


def dirty_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a record, copies and all."""
    return files(spark, sf).selectExpr(
        "doc_id as id", "hash", "name as original_name", "file_size", "extension", "modified_at as created_at",
        "modified_at as processed_at", "path as source_path", "path as target_path", "hash_type",
    )


def today_names(records: DataFrame) -> DataFrame:
    return names_in_use(records)


def as_file_events(events: DataFrame, *more: str) -> DataFrame:
    return events.selectExpr(
        *more,
        "concat('/src/', user_id, '.jpg') as path",
        "case event_type when 'click' then 'CREATE' when 'error' then 'REMOVE' else 'WRITE' end as op",
        "cast(ts as timestamp) as ts",
    )


# Kinds of log lines in the order of the number an event carries.
KINDS = [*OPERATIONS, "queue_full", "worker_done", "duplicate_delete", "slow_query", "batch_insert", "copy_summary"]


def duration_text() -> Column:
    return F.expr(
        "case event_type when 'click' then concat(value, 'ms') when 'view' then concat(value, 's')"
        " when 'error' then concat(value, 'µs') when 'purchase' then concat('1m', value, 's')"
        " else concat('1h0m', value, 's') end"
    )


def size_text() -> Column:
    return F.expr(
        "concat(value, case event_type when 'click' then ' KB' when 'view' then ' MB' when 'error' then ' B'"
        " when 'purchase' then ' GB' else ' TB' end)"
    )


def rendered(events: DataFrame) -> DataFrame:
    """One line per event, of all kinds of messages."""
    texts = OPERATIONS | EXTRA_OPERATIONS
    texts |= {"queue_full": "处理队列已满，跳过文件: /src/{user}.jpg", "worker_done": "智能工作协程 #{user} 完成，处理文件数: {count}"}
    value = F.col("value").cast("string")
    user = F.col("user_id").cast("string")
    message = F.coalesce(F.get(F.array(*(F.lit(texts[kind]) for kind in KINDS)), F.col("number")), F.lit("idle"))
    values = {
        "time": duration_text(),
        "other": duration_text(),
        "size": size_text(),
        "speed": F.concat(value, F.lit(" MB/s")),
        "file": F.concat(F.lit("IMG_"), user, F.lit(".jpg")),
        "any": F.lit(" (by hash)"),
        "user": user,
        "count": F.col("value").cast("int").cast("string"),
    }
    for name, text in values.items():
        message = F.replace(message, F.lit("{" + name + "}"), text)
    level = F.expr("case number when 18 then 'WARN' when 21 then 'WARN' when 19 then 'INFO' when 24 then 'ERROR' else 'DEBUG' end")
    caller = F.when(F.col("number") == 24, F.lit("unknown")).otherwise(F.concat(F.lit("worker.go:"), user))
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    number = F.expr("cast(regexp_extract(props, '[0-9]+', 0) as int) div 4").cast("int")
    return events.withColumn("number", number).select(
        F.concat(F.lit("["), time, F.lit("] "), level, F.lit(" "), caller, F.lit(" - "), message).alias("value")
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log as text files, which is how a log arrives."""
    path = scratch_path(spark, "log")
    rendered(table(spark, sf, "events")).write.text(path)
    return read_log(spark, path)
