import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyshelf import functions as fn
from tallyshelf.functions.hashing import hash_algorithm


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_extensions(spark):
    paths = ["/a/b.JPG", "/a/.bashrc", "/a/x.tar.gz", "/a.d/none", "/a/end.", "b.Png"]
    assert values(spark, paths, fn.file_extension) == [".jpg", ".bashrc", ".gz", "", ".", ".png"]
    assert values(spark, ["jpg", ".JPG", "Tiff"], fn.normalize_extension) == [".jpg", ".jpg", ".tiff"]


def test_names(spark):
    assert values(spark, ["/a/b c.jpg", "x", "/ü/ü.png"], fn.base_name) == ["b c.jpg", "x", "ü.png"]
    names = ["a.JPG", "x.tar.gz", ".bashrc", "none"]
    assert values(spark, names, fn.name_stem) == ["a", "x.tar", "", "none"]
    assert values(spark, names, lambda c: fn.suffixed_name(c, F.lit(7))) == ["a_7.JPG", "x.tar_7.gz", "_7.bashrc", "none_7"]


def test_date_and_join_path(spark):
    ts = F.lit("2024-03-05 01:02:03").cast("timestamp_ntz")
    assert values(spark, ["n.jpg"], lambda c: fn.join_path(F.lit("/t"), fn.date_path(ts), c)) == ["/t/2024/03/05/n.jpg"]


def test_walk_key_orders_like_a_walk(spark):
    paths = ["a-c", "a/b", "a/b/c", "ab", "a"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    ordered = [r.p for r in rows.orderBy(fn.walk_key("p")).collect()]
    assert ordered == sorted(paths, key=lambda p: [part.encode() for part in p.split("/")])
    assert ordered == ["a", "a/b", "a/b/c", "a-c", "ab"]


def test_hashes(spark):
    texts = ["", "abc", "ü"]
    assert values(spark, texts, fn.sha256_hex) == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert values(spark, texts, lambda c: fn.content_hash(c, "MD5")) == [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert hash_algorithm(None) == hash_algorithm("") == "sha256"
    with pytest.raises(ValueError):
        hash_algorithm("sha1")


def test_hash_prefix_leaves_short_text(spark):
    assert values(spark, ["0123456789abcdef", "0123"], fn.hash_prefix) == ["0123456789ab...", "0123"]


def size_text(n):
    """Expected size text, from exact binary fractions and even rounding."""
    if n < 1024:
        return f"{n} B"
    power = min(6, (n.bit_length() - 1) // 10)
    return f"{n / 1024**power:.1f} {' KMGTPE'[power]}B"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**50) | st.integers(0, 2**22), min_size=1, max_size=60))
def test_format_file_size(spark, sizes):
    sizes = [*sizes, 0, 1023, 1024, 1280, 1792, 1048575, 1048576, 1 << 62]
    assert values(spark, [str(n) for n in sizes], lambda c: fn.format_file_size(c.cast("bigint"))) == [size_text(n) for n in sizes]


def test_durations(spark):
    texts = ["350.4µs", "350.4μs", "1.5ms", "2s", "1m2.3s", "1h0m0s", "5ns", "7us", "x", "", "1.2.3ms", "1h1m1.5s"]
    found = values(spark, texts, fn.duration_ms)
    wanted = [0.3504, 0.3504, 1.5, 2000.0, 62300.0, 3.6e6, 5e-6, 7e-3, None, None, None, 3661500.0]
    assert all((f is None) == (w is None) and (f is None or math.isclose(f, w)) for f, w in zip(found, wanted))
    strict = values(spark, texts, lambda c: fn.duration_ms(c, strict=True))
    assert strict == [None, None, 1.5, 2000.0, *[None] * 8]


def test_sizes(spark):
    assert values(spark, ["512 B", "1.5 KB", "2.0 MB", "1.1 GB", "1 TB", "3 XB", "1.5KB"], fn.size_mb) == [
        512 / 2**20, 1.5 / 1024, 2.0, 1.1 * 1024, 1048576.0, None, None,
    ]


def test_transfer_speed_guards_zero(spark):
    assert values(spark, ["0", "500"], lambda c: fn.transfer_speed(F.lit(1048576), c.cast("double"))) == [None, 2.0]


def test_round_to_second(spark):
    assert values(spark, ["0.5", "1.49", "2.5", "0"], lambda c: fn.round_to_second(c.cast("double"))) == [1, 1, 3, 0]


def test_log_line(spark):
    lines = [
        "[2025-09-16 10:11:12] WARN worker.go:166 - 处理队列已满，跳过文件: /a/b - c.jpg",
        "[2025-09-16 10:11:12] INFO unknown - done",
        "no log line",
    ]
    first, second, third = values(spark, lines, fn.parse_log_line)
    assert str(first.ts) == "2025-09-16 10:11:12"
    assert (first.level, first.caller_file, first.caller_line) == ("WARN", "worker.go", 166)
    assert first.message == "处理队列已满，跳过文件: /a/b - c.jpg"
    assert (second.caller_file, second.caller_line, second.message) == ("unknown", None, "done")
    assert third is None
    assert values(spark, lines, fn.skipped_file_name) == ["/a/b - c.jpg", "Unknown", "Unknown"]


def test_levels(spark):
    assert values(spark, ["DEBUG", "info", "warning", "WARN", "Error", "odd"], fn.log_level_rank) == [0, 1, 2, 2, 3, 1]
