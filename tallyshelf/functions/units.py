"""Sizes, durations and rates, from and to text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col

# Milliseconds per duration unit, and unit letters of formatted sizes (base 1024).
UNIT_MS = {"h": 3_600_000.0, "m": 60_000.0, "s": 1_000.0, "ms": 1.0, "[µμu]s": 1e-3, "ns": 1e-6}
SIZE_MB = {"B": 2.0**-20, "KB": 2.0**-10, "MB": 1.0, "GB": 2.0**10, "TB": 2.0**20}
LONG_DURATION = "^" + "".join(f"(?:([0-9.]+){unit}(?![a-z]))?" for unit in UNIT_MS) + "$"
MARK = "\x01"
SIZE_UNITS = ["KB", "MB", "GB", "TB", "PB", "EB"]


def format_file_size(size: Column | str) -> Column:
    """Bytes as ``n B`` or ``x.y KB`` up to EB.

    Ties round to even (1280 bytes are ``1.2 KB``), hence ``bround`` before formatting.
    """
    size = col(size)
    text = F.format_string("%d B", size)
    for power, unit in enumerate(SIZE_UNITS, 1):
        scaled = F.bround(size.cast("double") / float(1024**power), 1)
        text = F.when(size >= F.lit(1024**power), F.format_string(f"%.1f {unit}", scaled)).otherwise(text)
    return text


def transfer_speed(size: Column | str, time_ms: Column | str) -> Column:
    """MB per second; null when no time passed."""
    seconds = col(time_ms) / 1000.0
    return F.when(seconds > 0, col(size) / seconds / float(1024**2))


def duration_ms(text: Column | str, strict: bool = False) -> Column:
    """Milliseconds of a duration such as ``350.4µs``, ``1.5ms``, ``2s`` or ``1h1m2.3s``.

    Strict takes plain milliseconds and seconds only. Anything else is null. No number is read
    before its text is known to be one, as a failed conversion costs far more than a test.
    """
    text = col(text)

    def without(letters: int) -> Column:
        return F.left(text, F.length(text) - letters).try_cast("double")

    plain = F.when(
        text.rlike(r"^[0-9.]+m?s$"), F.when(text.endswith("ms"), without(2)).otherwise(without(1) * 1000.0)
    )
    if strict:
        return plain
    parts = F.split(F.regexp_replace(text, LONG_DURATION, MARK.join(f"${n}" for n in range(1, 7))), MARK)
    times = F.zip_with(
        parts,
        F.array(*(F.lit(ms) for ms in UNIT_MS.values())),
        lambda part, ms: F.when(part != "", part.try_cast("double") * ms).otherwise(0.0),
    )
    long = F.aggregate(times, F.lit(0.0), lambda total, time: total + time)
    return plain.when(text.rlike(LONG_DURATION) & (text != ""), long)


def size_mb(text: Column | str) -> Column:
    """Megabytes of a size such as ``512 B``, ``1.5 KB`` or ``1.1 GB``; null for other text."""
    text = col(text)
    amount = F.substring_index(text, " ", 1).try_cast("double")
    unit = F.substring_index(text, " ", -1)
    factor = F.lit(1.0)
    for name, megabytes in SIZE_MB.items():
        factor = F.when(unit == name, megabytes).otherwise(factor)
    return F.when(text.rlike("^[0-9.]+ [KMGT]?B$"), amount * factor)


def round_to_second(seconds: Column | str) -> Column:
    """Elapsed seconds rounded half away from zero."""
    return F.round(col(seconds)).cast("bigint")
