"""Connected components of links, as joins and minima over shrinking stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stored


def _nodes(stars: DataFrame) -> DataFrame:
    """Every node ``c`` of links from ``v`` to the smaller ``m`` with ``low``, the least of it and its neighbours, and how many are smaller and larger."""
    up = F.struct(F.col("v").alias("c"), F.col("m").alias("o"), F.lit(1).alias("is_up"))
    down = F.struct(F.col("m").alias("c"), F.col("v").alias("o"), F.lit(0).alias("is_up"))
    return stars.select(F.inline(F.array(up, down))).groupBy("c").agg(
        F.least(F.min("o"), F.first("c")).alias("low"), F.sum("is_up").alias("smaller"), F.sum(1 - F.col("is_up")).alias("larger")
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to over any way, for every node with a link.

    Large and small stars in turn: every node hands its smallest neighbour first to its larger, then to its
    smaller neighbours, until each has one smaller neighbour and no larger, or none smaller. The rounds grow with the
    logarithm of the longest way; links that are stars already take none. A star's centre may have any
    number of links: minima are taken before the shuffle, and the join on the centre is one that adaptive
    execution splits. Links to null and of a node to itself say nothing. No links give no rows.
    """
    stars = stored(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where(f"{a} != {b}").distinct())
    nodes = stored(_nodes(stars))
    while not nodes.where("smaller > 1 or smaller > 0 and larger > 0").isEmpty():
        # Each link once: its smaller node hands its least neighbour to the larger.
        large = stars.join(nodes.select("c", "low"), F.col("m") == F.col("c")).select("v", F.col("low").alias("m"))
        centre = large.groupBy(F.col("v").alias("c")).agg(F.min("m").alias("low"))
        joined = large.join(centre, F.col("v") == F.col("c"))
        small = joined.where("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        stars = stored(small.union(centre.select(F.col("c").alias("v"), F.col("low").alias("m"))).distinct())
        del large, centre, joined, small
        nodes = stored(_nodes(stars))
        release(links.sparkSession)  # a round's shuffle files are of no use to the next
    return nodes.select(F.col("c").alias("node"), F.col("low").alias("root"))
