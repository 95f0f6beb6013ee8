"""Connected components of links between numbers, by alternating large-star and small-star rounds.

All rounds are DataFrame joins and minimum aggregates: a node that a third of all links touch is
pre-aggregated before the shuffle, and the join back is one that adaptive execution can split. Every round is
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(pairs: DataFrame, strict: bool) -> DataFrame:
    """Each node's neighbours (larger ones if strict, else smaller) linked to its least neighbour or itself."""
    if strict:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of links(u, v); nodes without links are left out."""
    now = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    while True:  # rounds grow with the logarithm of the longest chain, at worst squared
        large = _star(now, True).filter("u <> v").distinct()
        now = saved(_star(large, False).filter("u <> v").distinct(), "links")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
