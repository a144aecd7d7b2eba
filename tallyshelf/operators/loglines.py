"""From log text to performance samples, warnings and advice."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import duration_ms, parse_log_line, size_mb, skipped_file_name
from ..functions.logtext import MARK, log_line_fields, log_line_parts
from ..schemas import SLOW_LIMITS_MS
from .stats import top_bottleneck

# What the log says about each timed operation. Braces mark the values in a line:
# {time} a duration, {size} a size, {speed} a rate in MB/s, {file} a file name.
OPERATIONS = {
    "file_copy_detail": "⏱️ 文件复制详情: 耗时={time}, 大小={size}, 速度={speed}",
    "file_copy_total": "⏱️ 文件复制总耗时: {time}",
    "file_copy": "⏱️ 文件复制耗时: {time}",
    "hash_calculation_detail": "⏱️ 哈希计算详情: 总耗时={time}, 读取耗时={other}, 文件大小={size}, 读取速度={speed}",
    "hash_calculation_total": "⏱️ 哈希计算总耗时: {time}",
    "hash_calculation": "⏱️ 哈希计算耗时: {time}",
    "database_insert": "⏱️ 数据库插入耗时{any}: {time}",
    "database_query": "⏱️ 数据库查询耗时{any}: {time}",
    "file_move_total": "⏱️ 文件移动总耗时: {time} -> {file}",
    "file_move": "⏱️ 文件移动耗时: {time} (文件大小: {size})",
    "directory_creation": "⏱️ 目录创建耗时: {time}",
    "permission_copy": "⏱️ 权限复制耗时: {time}",
    "file_delete": "⏱️ 源文件删除耗时: {time}",
    "file_processing_total": "⏱️ 文件处理总耗时: {file} -> {time}",
    "conflict_check": "⏱️ 文件冲突检查耗时: {time}",
    "file_info": "⏱️ 获取文件信息耗时: {time}",
    "file_open": "⏱️ 文件打开耗时: {time}",
    "path_generation": "⏱️ 路径生成耗时: {time}",
}

# Timings the log holds besides.
EXTRA_OPERATIONS = {
    "duplicate_delete": "⏱️ 删除重复文件耗时: {time}",
    "copy_summary": "⏱️ 文件复制完成: 耗时={time}, 大小={size}, 速度={speed}",
    "source_open": "⏱️ 打开源文件耗时: {time}",
    "target_create": "⏱️ 创建目标文件耗时: {time}",
    "batch_insert": "批量数据库插入{any}: {time}",
    "slow_query": "⚠️ 数据库查询耗时较长{any}: {time}",
}

# The warning about a full queue, and the line of a worker that is done.
QUEUE_FULL = "处理队列已满"
WORKER_DONE = r"智能工作协程 #(\d+) 完成，处理文件数: (\d+)"

# How numbers, times and sizes are written; strict knows the first form of each only.
NUMBER = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
STRICT_TIME, ANY_TIME = rf"{NUMBER}(?:ms|s)", rf"(?:{NUMBER}(?:h|ms|m|[µμu]s|ns|s))+"
STRICT_SIZE, ANY_SIZE = rf"{NUMBER} (?:KB|MB)", rf"{NUMBER} (?:B|KB|MB|GB|TB)"

OPERATION_NAMES = {
    "file_copy_detail": "File copy details",
    "file_copy_total": "File copy, total time",
    "file_copy": "File copy",
    "hash_calculation_detail": "Hash calculation details",
    "hash_calculation_total": "Hash calculation, total time",
    "hash_calculation": "Hash calculation",
    "database_insert": "Database insert",
    "database_query": "Database query",
    "file_move_total": "File move, total time",
    "file_move": "File move",
    "directory_creation": "Directory creation",
    "permission_copy": "Permission copy",
    "file_delete": "Source file removal",
    "file_processing_total": "File processing, total time",
    "conflict_check": "Name conflict check",
    "file_info": "File information",
    "file_open": "File open",
    "path_generation": "Path generation",
}


FIELDS = ["time", "size", "speed", "file"]


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def _compile(template: str, strict: bool) -> tuple[str, str, dict[str, int]]:
    """Regular expression of a message, its fixed beginning, and the group number of each value."""
    kinds = {
        "time": STRICT_TIME if strict else ANY_TIME,
        "other": STRICT_TIME if strict else ANY_TIME,
        "size": STRICT_SIZE if strict else ANY_SIZE,
        "speed": NUMBER,
        "file": r".+",
        "any": r".*?",
    }
    pieces = template.replace("{", "}").split("}")
    pattern, groups = "", {}
    for i, piece in enumerate(pieces):
        if i % 2:
            groups[piece] = len(groups) + 1
            pattern += f"({kinds[piece]})" + (" MB/s" if piece == "speed" else "")
        else:
            pattern += _escape(piece)
    return pattern, pieces[0], groups


def _hit(operation: str, template: str, strict: bool) -> Column:
    """Operation and values of a line in one marked text, taken by one pass of one pattern.

    Null, or the line as it was, if the line does not report the operation.
    """
    pattern, begin, groups = _compile(template, strict)
    values = MARK.join(f"${groups[f]}" if f in groups else "" for f in FIELDS)
    marked = F.regexp_replace("line", f"^.*?{pattern}.*$", operation + MARK + values)
    return F.when(F.col("line").contains(begin), marked)


def log_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines in the log layout as ts, level, caller_file, caller_line, message and the line itself.

    The parts are generated as rows of their own, so that they are taken from a line once and
    not again by the filter.
    """
    split = lines.select(F.col(line).alias("line"), F.explode(F.array(log_line_parts(line))).alias("parts"))
    return split.where(F.size("parts") == 5).select(*log_line_fields("parts"), "line")


def timed(line: str = "value", extra: bool = False) -> Column:
    """A plain text test that every line with a timing passes."""
    signs = F.col(line).contains("⏱️")
    if extra:
        signs = signs | F.col(line).contains("⚠️") | F.col(line).contains("批量数据库插入")
    return signs


def is_queue_warning(line: str = "value") -> Column:
    return F.col(line).contains("WARN") & F.col(line).contains(QUEUE_FULL)


def classify_operations(lines: DataFrame, strict: bool = False, extra: bool = False, line: str = "value") -> DataFrame:
    """Performance samples: one row per line and operation it reports.

    A line that fits several messages gives several rows. Lines without the timer sign are
    dropped by a plain text test before any pattern is tried, and a pattern is tried only on
    lines that hold its fixed beginning. ``strict`` accepts only the plain units and the
    main messages; ``extra`` adds the other timings.
    """
    extra = extra and not strict
    operations = OPERATIONS | (EXTRA_OPERATIONS if extra else {})
    candidates = lines.where(timed(line, extra)).select(F.trim(F.translate(line, MARK, "")).alias("line"))
    hits = F.array(*(_hit(operation, template, strict) for operation, template in operations.items()))
    matched = candidates.select("line", F.explode(hits).alias("hit")).where(F.col("hit").contains(MARK))
    values = matched.select("line", F.split("hit", MARK).alias("v"))

    def value(field: str) -> Column:
        return F.col("v")[1 + FIELDS.index(field)]

    return values.select(
        F.col("v")[0].alias("operation"),
        duration_ms(value("time")).alias("time_ms"),
        size_mb(value("size")).alias("size_mb"),
        F.nullif(value("speed"), F.lit("")).try_cast("double").alias("speed_mbps"),
        F.nullif(value("file"), F.lit("")).alias("filename"),
        "line",
    )


def operation_names(samples: DataFrame) -> DataFrame:
    """Add the display name of the operation; an unknown one is its own name.

    The names are few and fixed, so they are looked up in a literal map: no join, and the
    order of a ranking stays as it is.
    """
    names = F.create_map(*(F.lit(text) for pair in OPERATION_NAMES.items() for text in pair))
    return samples.withColumn("name", F.coalesce(names[F.col("operation")], F.col("operation")))


def queue_warnings(lines: DataFrame, line: str = "value") -> DataFrame:
    """Warnings that the queue was full."""
    return lines.where(is_queue_warning(line))


def warning_count(lines: DataFrame, line: str = "value") -> DataFrame:
    return queue_warnings(lines, line).agg(F.count("*").alias("warnings"))


def first_warnings(lines: DataFrame, k: int = 5, line: str = "value") -> DataFrame:
    """The first ``k`` queue warnings by log time, and the files they name."""
    text = F.trim(F.col(line))
    warnings = queue_warnings(lines, line).select(parse_log_line(text)["ts"].alias("ts"), text.alias("line"))
    return warnings.orderBy(F.col("ts").asc_nulls_last(), "line").limit(k).select(
        "ts", skipped_file_name("line").alias("file_name"), "line"
    )


def worker_counts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Files per worker, from the lines workers write when they are done."""
    done = lines.where(F.col(line).rlike(WORKER_DONE)).select(
        F.regexp_extract(line, WORKER_DONE, 1).try_cast("bigint").alias("worker_id"),
        F.regexp_extract(line, WORKER_DONE, 2).try_cast("bigint").alias("files"),
    )
    return done.groupBy("worker_id").agg(F.sum("files").alias("files"))


def slow_operations(samples: DataFrame, limits_ms: dict[str, float] | None = None) -> DataFrame:
    """Samples above the limit of their operation."""
    tests = [
        (F.col("operation") == operation) & (F.col("time_ms") > limit)
        for operation, limit in (limits_ms or SLOW_LIMITS_MS).items()
    ]
    slow: Column = tests[0]
    for test in tests[1:]:
        slow = slow | test
    return samples.where(slow)


class Advice(NamedTuple):
    """What to say of a log: ``top`` for the operation that takes the most time, by a part of its name
    (the first that fits counts), ``always``, and ``warned`` if the queue was full."""

    top: dict[str, list[str]]
    always: list[str]
    warned: list[str]


DEFAULT_ADVICE = Advice(
    top={
        "copy": ["See whether the target disk or the network is the limit", "Try other buffer sizes for copying"],
        "hash": ["Compare hash algorithms on a sample of the files", "Read files in larger pieces"],
        "directory": ["Make folders ahead of the files that go there"],
        "database": ["Look at the slowest statements and their plans", "Write more rows in one statement"],
    },
    always=["Compare these times with those of an earlier log before changing anything"],
    warned=["Files were not taken because the queue was full: use more workers, or a longer queue"],
)


def recommendations(samples: DataFrame, lines: DataFrame, line: str = "value", advice: Advice = DEFAULT_ADVICE) -> DataFrame:
    """``section``, ``place``, ``advice``: on the top operation, in general, and on the queue after warnings.

    Each section comes from a one-row aggregate.
    """
    return advise(top_bottleneck(samples), warning_count(lines, line), advice)


def advise(top: DataFrame, warnings: DataFrame, advice: Advice = DEFAULT_ADVICE) -> DataFrame:
    """``recommendations`` from the top operation and the number of warnings, one row each."""

    def texts(found: list[str]) -> Column:
        return F.array(*map(F.lit, found)).cast("array<string>")

    for_top = texts([])
    for part, found in reversed(advice.top.items()):
        for_top = F.when(F.col("operation").contains(part), texts(found)).otherwise(for_top)
    headline = F.format_string("%s takes the most time: %.2f ms", F.col("name"), F.col("total_ms"))
    first = operation_names(top).select(
        F.lit(1).alias("section"), F.posexplode(F.concat(F.array(headline), for_top)).alias("place", "advice")
    )

    def fixed(section: int, found: list[str], rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.posexplode(texts(found)).alias("place", "advice"))

    general = fixed(2, advice.always, warnings)
    return first.unionByName(general).unionByName(fixed(3, advice.warned, warnings.where("warnings > 0"))).orderBy("section", "place")
