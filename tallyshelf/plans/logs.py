"""The whole log report."""

from pyspark.sql import DataFrame

from ..operators.loglines import (
    DEFAULT_ADVICE,
    Advice,
    advise,
    classify_operations,
    first_warnings,
    is_queue_warning,
    operation_names,
    timed,
    warning_count,
)
from ..operators.stats import latency_stats, top_by_avg_time, top_by_total_time, top_bottleneck, transfer_stats
from ..session import settle


def analyze_log(
    lines: DataFrame, strict: bool = False, extra: bool = False, line: str = "value", advice: Advice = DEFAULT_ADVICE
) -> dict[str, DataFrame]:
    """All parts of the report by name.

    The log's text is read once: the lines that matter, by plain text tests, are written down. Their
    samples are parsed once and written too; every part reads the few columns it needs.
    """
    found = settle(lines.where(timed(line, extra and not strict) | is_queue_warning(line)), "log-lines")
    samples = settle(classify_operations(found, strict, extra, line).drop("line"), "samples")
    counted = warning_count(found, line)
    return {
        "latency": operation_names(latency_stats(samples)),
        "transfer": operation_names(transfer_stats(samples)),
        "top_by_total_time": operation_names(top_by_total_time(samples)),
        "top_by_avg_time": operation_names(top_by_avg_time(samples)),
        "warning_count": counted,
        "first_warnings": first_warnings(found, line=line),
        "recommendations": advise(top_bottleneck(samples), counted, advice),
    }
