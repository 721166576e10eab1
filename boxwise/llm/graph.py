"""Connected components of a table of links, by alternating star steps.

Large-star links the larger neighbours of every node to its smallest one, small-star the
smaller ones; after a few rounds each node is linked to the smallest of its component only.
Minima are aggregated before the shuffle and joined back, so a node with very many links
gathers nothing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges).join(least.select(F.col("u").alias("v"), F.col("m")), "v", "left")
    large = large.select("u", F.least(F.col("v"), F.coalesce("m", "v")).alias("v")).filter("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark = None
    for _ in range(most_rounds):
        new = (now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
        now = materialize(_stars(now))
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
