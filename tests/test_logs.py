import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import filters, loglines, stats
from tallyshelf.plans import analyze_log


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def stamped(message, level="DEBUG", second=0):
    return f"[2025-09-16 10:00:{second:02d}] {level} worker.go:7 - {message}"


# One written line per operation, and the values it holds: time, size, speed, file.
WRITTEN = [
    ("file_copy_detail", "⏱️ 文件复制详情: 耗时=1.5ms, 大小=2.0 MB, 速度=3.25 MB/s", 1.5, 2.0, 3.25, None),
    ("file_copy_total", "⏱️ 文件复制总耗时: 2s", 2000.0, None, None, None),
    ("file_copy", "⏱️ 文件复制耗时: 3ms", 3.0, None, None, None),
    ("hash_calculation_detail", "⏱️ 哈希计算详情: 总耗时=4ms, 读取耗时=1ms, 文件大小=512.0 KB, 读取速度=99.5 MB/s", 4.0, 0.5, 99.5, None),
    ("hash_calculation_total", "⏱️ 哈希计算总耗时: 5ms", 5.0, None, None, None),
    ("hash_calculation", "⏱️ 哈希计算耗时: 6.5ms (文件大小: 1.0 MB)", 6.5, None, None, None),
    ("database_insert", "⏱️ 数据库插入耗时: 7ms", 7.0, None, None, None),
    ("database_query", "⏱️ 数据库查询耗时 (by hash): 8ms", 8.0, None, None, None),
    ("file_move_total", "⏱️ 文件移动总耗时: 9ms -> a b.jpg", 9.0, None, None, "a b.jpg"),
    ("file_move", "⏱️ 文件移动耗时: 10ms (文件大小: 1024.0 KB)", 10.0, 1.0, None, None),
    ("directory_creation", "⏱️ 目录创建耗时: 11ms", 11.0, None, None, None),
    ("permission_copy", "⏱️ 权限复制耗时: 12ms", 12.0, None, None, None),
    ("file_delete", "⏱️ 源文件删除耗时: 13ms", 13.0, None, None, None),
    ("file_processing_total", "⏱️ 文件处理总耗时: x -> y.jpg -> 14ms", 14.0, None, None, "x -> y.jpg"),
    ("conflict_check", "⏱️ 文件冲突检查耗时: 15ms", 15.0, None, None, None),
    ("file_info", "⏱️ 获取文件信息耗时: 16ms", 16.0, None, None, None),
    ("file_open", "⏱️ 文件打开耗时: 17ms", 17.0, None, None, None),
    ("path_generation", "⏱️ 路径生成耗时: 18ms", 18.0, None, None, None),
]


@pytest.mark.parametrize("strict", [False, True])
def test_every_operation_is_found(spark, strict):
    log = lines(spark, [stamped(w[1]) for w in WRITTEN])
    found = loglines.classify_operations(log, strict=strict).collect()
    assert sorted((r.operation, r.time_ms, r.size_mb, r.speed_mbps, r.filename) for r in found) == sorted(
        (op, t, size, speed, file) for op, _, t, size, speed, file in WRITTEN
    )
    assert {r.line for r in found} == {stamped(w[1]) for w in WRITTEN}


def test_units(spark):
    times = {"350.4µs": 0.3504, "1m2.3s": 62300.0, "1h0m0s": 3.6e6, "1.2.3ms": None, "soon": None, "2s": 2000.0}
    log = lines(spark, [stamped(f"⏱️ 文件打开耗时: {t}") for t in times])
    found = sorted(r.time_ms for r in loglines.classify_operations(log).collect())
    assert found == pytest.approx(sorted(t for t in times.values() if t is not None))
    assert [r.time_ms for r in loglines.classify_operations(log, strict=True).collect()] == [2000.0]
    log = lines(spark, [stamped(f"⏱️ 文件移动耗时: 1ms (文件大小: {s})") for s in ("512.0 B", "1.0 GB", "1.0 MB")])
    assert sorted(r.size_mb for r in loglines.classify_operations(log).collect()) == [512 / 2**20, 1.0, 1024.0]
    assert [r.size_mb for r in loglines.classify_operations(log, strict=True).collect()] == [1.0]


def test_a_line_may_report_several_operations(spark):
    text = stamped("⏱️ 文件打开耗时: 1ms; ⏱️ 路径生成耗时: 2ms")
    found = loglines.classify_operations(lines(spark, [text, "⏱️ nothing", "文件打开耗时: 1ms", ""])).collect()
    assert sorted((r.operation, r.time_ms) for r in found) == [("file_open", 1.0), ("path_generation", 2.0)]


def test_extra_operations(spark):
    texts = [
        stamped("⏱️ 删除重复文件耗时: 1ms"), stamped("⚠️ 数据库查询耗时较长 (by hash): 150ms", "WARN"),
        stamped("⚠️ 批量数据库插入耗时较长: 2s (记录数: 50)", "WARN"), stamped("✅ 批量数据库插入完成: 20ms (记录数: 50)", "INFO"),
        stamped("⏱️ 打开源文件耗时: 3ms"), stamped("⏱️ 创建目标文件耗时: 4ms"),
        stamped("⏱️ 文件复制完成: 耗时=1ms, 大小=1.0 MB, 速度=5.00 MB/s"), stamped("⏱️ 数据库查询耗时 (x): 101ms"),
    ]
    log = lines(spark, texts)
    assert {r.operation for r in loglines.classify_operations(log).collect()} == {"database_query"}
    found = loglines.classify_operations(log, extra=True)
    assert sorted(r.operation for r in found.collect()) == [
        "batch_insert", "batch_insert", "copy_summary", "database_query", "duplicate_delete", "slow_query",
        "source_open", "target_create",
    ]
    slow = loglines.slow_operations(found).collect()
    assert sorted((r.operation, r.time_ms) for r in slow) == [("batch_insert", 2000.0), ("database_query", 101.0)]
    assert loglines.slow_operations(found, {"source_open": 2.5}).count() == 1
    assert loglines.classify_operations(log, strict=True, extra=True).count() == 1


def test_warnings(spark):
    texts = [stamped(f"处理队列已满，跳过文件: /s/{n}.jpg", "WARN", 30 - n) for n in range(7)]
    texts += [stamped("处理队列已满", "INFO"), stamped("slow", "WARN"), "WARN 处理队列已满"]
    log = lines(spark, texts)
    assert loglines.warning_count(log).first()[0] == 8
    assert [r.file_name for r in loglines.first_warnings(log).collect()] == [f"/s/{n}.jpg" for n in (6, 5, 4, 3, 2)]
    assert [r.file_name for r in loglines.first_warnings(log, 8).collect()][-1] == "Unknown"


def test_levels_and_workers(spark):
    texts = [stamped("a", level) for level in ("DEBUG", "INFO", "WARN", "ERROR")] + ["junk"]
    texts += [stamped(f"智能工作协程 #{w} 完成，处理文件数: {n}", "INFO") for w, n in ((1, 5), (2, 7), (1, 3))]
    log = lines(spark, texts)
    events = loglines.log_events(log)
    assert events.count() == 7
    assert filters.filter_log_level(events, "warn").count() == 2
    assert filters.filter_log_level(events, "odd").count() == 6
    assert {r.worker_id: r.files for r in loglines.worker_counts(log).collect()} == {1: 8, 2: 7}


def samples(spark, rows):
    return spark.createDataFrame(rows, "operation string, time_ms double")


@pytest.mark.parametrize("seed", range(3))
def test_median_is_exact(spark, seed):
    rng = random.Random(seed)
    groups = {
        "even": [rng.lognormvariate(0, 3) for _ in range(100)],
        "odd": [float(rng.randrange(5)) for _ in range(101)],
        "one": [4.25],
        "two": [0.0, 1e9],
        "flat": [7.0] * 50,
        "close": [1000 + rng.random() / 10 for _ in range(60)],
        "zeros": [0.0] * 10 + [5.0] * 10,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    found = {r.operation: r.median for r in stats.exact_median(samples(spark, rows), "operation", "time_ms").collect()}
    assert found == {g: statistics.median(vs) for g, vs in groups.items()}


def test_latency_matches_the_statistics_module(spark):
    rng = random.Random(9)
    groups = {"a": [rng.random() * 100 for _ in range(57)], "b": [3.5], "c": [1.0, 2.0]}
    found = stats.latency_stats(samples(spark, [(g, v) for g, vs in groups.items() for v in vs])).collect()
    for r in found:
        vs = groups[r.operation]
        assert (r["count"], r.min_ms, r.max_ms, r.median_ms) == (len(vs), min(vs), max(vs), statistics.median(vs))
        assert r.avg_ms == pytest.approx(statistics.mean(vs))
        assert r.stddev_ms == (pytest.approx(statistics.stdev(vs)) if len(vs) > 1 else None)


def test_rankings_and_names(spark):
    rows = [("file_open", 1.0)] * 10 + [("odd_one", 50.0)] + [(f"x{i:02d}", 0.5) for i in range(12)]
    frame = samples(spark, rows)
    top = [r.operation for r in stats.top_by_total_time(frame).collect()]
    assert top == ["odd_one", "file_open", *(f"x{i:02d}" for i in range(8))]
    assert stats.top_by_avg_time(frame).first().avg_ms == 50.0
    assert stats.top_bottleneck(frame).count() == 1
    named = {r.operation: r.name for r in loglines.operation_names(frame).collect()}
    assert named["file_open"] == "File open" and named["odd_one"] == "odd_one"
    report = stats.performance_report(frame).first().operations
    assert report["file_open"].asDict() == {"avg_ms": 1.0, "count": 10}


ADVICE = loglines.Advice(top={"copy": ["a", "b"], "file": ["c"]}, always=["d"], warned=["e"])


@pytest.mark.parametrize(
    ("operation", "advice"), [("file_copy_total", ["a", "b"]), ("file_info", ["c"]), ("directory_creation", [])]
)
def test_recommendations(spark, operation, advice):
    frame = samples(spark, [(operation, 10.0), ("path_generation", 1.0)])
    quiet = loglines.recommendations(frame, lines(spark, ["nothing"]), advice=ADVICE).collect()
    assert [(r.section, r.place) for r in quiet] == [*((1, k) for k in range(len(advice) + 1)), (2, 0)]
    first = [r.advice for r in quiet if r.section == 1]
    assert first[0].endswith("takes the most time: 10.00 ms") and first[1:] == advice
    warned = loglines.recommendations(frame, lines(spark, ["WARN 处理队列已满"]), advice=ADVICE).collect()
    assert [r.advice for r in warned][-2:] == ["d", "e"] and warned[-1].section == 3
    none = loglines.recommendations(frame.limit(0), lines(spark, [])).collect()
    assert {r.section for r in none} == {2}


def test_whole_report(spark):
    report = analyze_log(lines(spark, [stamped(w[1]) for w in WRITTEN] + [stamped("处理队列已满，跳过文件: /q.jpg", "WARN")]))
    assert report["latency"].count() == 18
    assert report["top_by_total_time"].first().operation == "file_copy_total"
    assert report["transfer"].count() == 2
    assert report["warning_count"].first()[0] == 1
    assert report["first_warnings"].first().file_name == "/q.jpg"
    assert report["recommendations"].where("section = 3").count() == 1


def test_log_is_matched_after_a_plain_text_test(spark, tmp_path):
    lines(spark, [stamped(WRITTEN[0][1])]).write.text(str(tmp_path / "log"))
    plan = loglines.classify_operations(spark.read.text(str(tmp_path / "log")))
    assert "StringContains(value,⏱️)" in plan._jdf.queryExecution().executedPlan().toString()


def test_missing_layout_is_dropped(spark):
    assert loglines.log_events(lines(spark, ["[x] INFO a - b", "[2025-01-01 00:00:00] TRACE a:1 - b"])).select(
        F.col("level"), F.col("ts")
    ).collect() == [("INFO", None)]
