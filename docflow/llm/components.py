"""Connected components of links in a table, by alternating large and small stars; nothing but a count comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint

SMALL = 500_000  # nodes that may be broadcast


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of links (a, b): root is the least node of its component.

    Minima are summed in each task before they are dealt. They are joined back by node: broadcast while they are few; beyond
    that the shuffled join's skew handling splits a node with many links.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(broadcast_if_small(checkpoint(least), SMALL), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(broadcast_if_small(checkpoint(least), SMALL), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
