"""URL rules and lists, through a blocked Bloom filter and an exact hash join.

A listed canonical URL is a host and the beginning of a path, like ``example.net/en/``; it stands
for the host and all its subdomains. Every canonical form a page's URL could be listed under
(the suffixes of its host, by label, with the beginnings of its path that have a listed length) is
looked up in a blocked Bloom filter: one 64-bit block per entry, with a few bits set. The filter
has a fixed number of blocks, so it is broadcast whatever the length of the list. Possible hits go
on to an exact join with the list, which removes the false positives. Of the entries found the
longest decides; without one the URL is allowed.

URLs are folded to distinct ones before anything is looked up, and possible hits to distinct
forms, so a host with a third of all pages costs a row per URL once.

Defined results: a null URL, or one without ``://``, has an empty host and path and matches
nothing but an entry for the empty host. Of entries of one length the longer host decides, then
the first in order; if one canonical URL is listed with several verdicts, ``block`` stands. Null
entries are left out. Repeated pages each get their row. Other columns are not looked at; an empty
list or table is fine.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frames import id_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits an entry sets in its block.
BITS = 6


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _bits(key: Column) -> Column:
    """A 64-bit mask with up to BITS bits, six of the hash's bits for each."""
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("bigint")
    for k in range(BITS):
        place = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """``block``, ``held``: the filter's non-empty blocks, at most ``blocks`` rows."""
    key = F.col(keys.columns[0])
    return keys.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_bits(key)).alias("held"))


def forms(host: Column, path: Column, lengths: list[int]) -> Column:
    """All canonical forms a URL may be listed under, as an array."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    long_enough = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    paths = F.array_compact(F.array(*long_enough)) if lengths else F.array().cast("array<string>")
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int = 1 << 16,
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (the entry that decides, or null) and ``verdict``.

    ``listed`` has ``host`` (lower case), ``path`` and ``verdict`` (``allow`` or ``block``). Only
    the distinct lengths of listed paths come to the driver.
    """
    entries = (
        listed.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", F.lit("\n"), "path").alias("form"), "host", "path", "verdict")
    )
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.where("url is not null").groupBy("url").agg(F.lit(1).alias("one")).select("url")
    looked = urls.select("url", F.explode(forms(host_of(F.col("url")), path_of(F.col("url")), sorted(lengths))).alias("form"))
    held = bloom_filter(entries.select("form"), blocks)
    probed = looked.select("url", "form", _block(F.col("form"), blocks).alias("block"), _bits(F.col("form")).alias("bits"))
    possible = probed.join(F.broadcast(held), "block").where(F.col("held").bitwiseAND(F.col("bits")) == F.col("bits"))
    hits = possible.select("url", "form").join(entries, "form")
    rank = F.struct(
        F.length("form").alias("length"),
        F.length("host").alias("host_length"),
        F.col("verdict"),
        F.translate("form", "\n", "").alias("rule"),
    )
    best = hits.groupBy("url").agg(F.max(rank).alias("best"))
    judged = best.select(F.col("url").alias("known"), "best.rule", "best.verdict")
    out = rows.join(judged, rows["url"] == judged["known"], "left")
    return out.select(
        F.col("id").cast(id_type(pages, id_col)).alias(id_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
