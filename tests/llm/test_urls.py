"""URL rules against a plain loop, and the Bloom filter by itself."""

import random
import re

from pyspark.sql import functions as F

from tallyshelf.llm import queries, urls

from .helpers import rows

SCHEMA = "page_id bigint, url string, host string, path string, rule string, block string, form string"
LIST = "host string, path string, verdict string"


def expected(pages, rules):
    out = []
    for page, url in pages:
        host = path = ""
        if url is not None and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=(None, None, "allow"))
        out.append((page, host, path, best[0] + best[1] if fit else None, best[2]))
    return sorted(out, key=repr)


def frame(spark, pages):
    return spark.createDataFrame([(p, u, "h", "p", "r", "b", "f") for p, u in pages], SCHEMA)


ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "://"), (6, "http://NET/"), (7, "http://a.Example.NET/en/x?y#z"),
    (8, "http://net"), (9, "http://fr.org/fr/"), (10, "http://x.org/fr"), (11, "https://example.com/de/a\nb"), (12, "http://a..net/"),
    (13, "http://É.net/ü"), (14, "x://y://net/"), (15, "http://user@example.net:80/en/"), (16, "http://example.net#/en/"),
    (None, "http://a.net/q"), (7, "http://a.Example.NET/en/x?y#z"), (17, "http://" + "a." * 300 + "net/" + "p" * 9000),
]


def test_rules_of_the_query(spark):
    listed = spark.createDataFrame(queries.RULES, LIST)
    many = [(100 + i, f"http://w{i % 7}.example.net/en/{i % 50}") for i in range(400)]
    got = urls.judge(frame(spark, ODD + many), listed).select("page_id", "host", "path", "rule", "verdict")
    assert rows(got) == expected(ODD + many, queries.RULES)


def test_many_entries_and_small_filters(spark):
    rng = random.Random(1)
    label = lambda: rng.choice("abcd")
    entries = {(".".join(label() for _ in range(rng.randrange(1, 4))), "/" + "".join(label() for _ in range(rng.randrange(0, 3)))) for _ in range(60)}
    rules = [(*e, rng.choice(["allow", "block"])) for e in sorted(entries)]
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("a", "/", None)], LIST)
    pages = [(i, f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{''.join(label() for _ in range(5))}") for i in range(300)]
    want = expected(pages, rules)
    for blocks in (1, 64, 1 << 16):  # more false positives must not change a row
        got = urls.judge(frame(spark, pages), listed, blocks=blocks).select("page_id", "host", "path", "rule", "verdict")
        assert rows(got) == want


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("form"))
    held = urls.bloom_filter(keys, 32)
    assert held.count() <= 32
    probed = keys.select(urls._block(F.col("form"), 32).alias("block"), urls._bits(F.col("form")).alias("bits"))
    assert probed.join(held, "block").where("held & bits = bits").count() == 500


def test_empty_list_and_table(spark):
    none = spark.createDataFrame([], LIST)
    assert {(r.rule, r.verdict) for r in urls.judge(frame(spark, ODD), none).collect()} == {(None, "allow")}
    assert urls.judge(frame(spark, []), spark.createDataFrame(queries.RULES, LIST)).count() == 0
