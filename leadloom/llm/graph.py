"""Connected components of a graph of links, over Spark shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that has a link (columns a and b); component is the smallest id reachable.

    Alternating large-star and small-star rounds until a round changes
    nothing.  The least neighbour of each node is written out before it is
    joined back, so both sides of the join are plain shuffles and a node with
    very many links can be split; every round is written to the checkpoint
    folder.
    """
    u, v = F.col("u"), F.col("v")
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(u != v).distinct())
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = cut_lineage(both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).filter(u != v).distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = after
    stars = after.select(u.alias("id"), v.alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
