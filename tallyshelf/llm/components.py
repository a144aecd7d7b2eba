"""Connected components of a table of links, by alternating large and small stars.

No link, node or component reaches the driver: a round is two joins, its links are written to the
shared folder, and only the number of nodes that are not yet part of a star is read. The links of a hot centre are
folded by a partial minimum and joined back by a join whose large side Spark may split.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.session import settle

from ._frames import join_anew


def _pair(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _with_least(links: DataFrame) -> DataFrame:
    """Each link with the least neighbour of its ``u``."""
    return join_anew(links, links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Links whose ``u`` is the greater end give links of that kind."""
    near = _with_least(links.select(F.inline(F.array(_pair("u", "v"), _pair("v", "u"))))).where("v > u")
    return near.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    return _with_least(links).select(F.inline(F.array(_pair("v", "m"), _pair("u", "m"))))


def _loose(links: DataFrame) -> int:
    """How many nodes have two lesser neighbours, or lesser and greater ones: none once all components are stars."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))
    nodes = links.select(F.inline(ends)).groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    return nodes.agg(F.expr("count_if(down > 0 and all > 1)")).first()[0]


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """Each linked node's least reachable node.

    ``links`` has two columns of one ordered type. Returns ``node``, ``root`` for every node other
    than a root; a node without links, or a root, has no row. Links from a node to itself,
    repeated links and an empty table are fine; a link with a null end is left out.
    """
    u, v = links.columns
    ends = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    now = settle(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while _loose(now):
        now = settle(_small_star(_large_star(now)).where("u <> v").distinct(), label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
