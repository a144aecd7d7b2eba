"""Pieces of a log line."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col

# The line layout, the level order and the text that precedes a skipped file.
LOG_LINE = r"^\[([^\]]+)\] (DEBUG|INFO|WARN|ERROR) ([^\s:]+)(?::(\d+))? - (.*)$"
LOG_TIME = "yyyy-MM-dd HH:mm:ss"
LEVEL_RANKS = {"debug": 0, "info": 1, "warn": 2, "warning": 2, "error": 3}
SKIPPED_FILE = "跳过文件: "

MARK = "\x01"


def log_line_parts(line: Column | str) -> Column:
    """Array of the five parts of a log line, by one pass of one pattern; one element for other text."""
    text = F.translate(col(line), MARK, "")
    return F.split(F.regexp_replace(text, LOG_LINE, MARK.join(f"${n}" for n in range(1, 6))), MARK)


def log_line_fields(parts: Column | str) -> list[Column]:
    """ts, level, caller_file, caller_line and message, from the parts of a line."""
    parts = col(parts)
    return [
        F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit(LOG_TIME)).cast("timestamp_ntz").alias("ts"),
        F.get(parts, F.lit(1)).alias("level"),
        F.get(parts, F.lit(2)).alias("caller_file"),
        F.get(parts, F.lit(3)).try_cast("int").alias("caller_line"),
        F.get(parts, F.lit(4)).alias("message"),
    ]


def parse_log_line(line: Column | str) -> Column:
    """Struct of ts, level, caller_file, caller_line and message; null if the line has another layout."""
    parts = log_line_parts(line)
    return F.when(F.size(parts) == 5, F.struct(*log_line_fields(parts)))


def log_level_rank(level: Column | str) -> Column:
    """debug 0, info 1, warn or warning 2, error 3; unknown text counts as info."""
    level = F.lower(col(level))
    rank = F.lit(LEVEL_RANKS["info"])
    for name, value in LEVEL_RANKS.items():
        rank = F.when(level == name, value).otherwise(rank)
    return rank


def skipped_file_name(line: Column | str) -> Column:
    """The file a queue-full warning names, or ``Unknown``."""
    line = col(line)
    return F.when(line.contains(SKIPPED_FILE), F.substring_index(line, SKIPPED_FILE, -1)).otherwise("Unknown")
