"""Connected parts of a graph of pairs, by spreading the smallest name and jumping along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.session import materialize


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, part) for edges (keys, a, b); the part is the smallest node that can be reached.

    Each round every node takes the smallest name among its neighbours' and then that name's own name; names halve their
    distance to the root at least, so rounds are few. All rounds are joins and aggregates on (keys, node).
    """
    both = materialize(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = materialize(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("part")))
    while True:
        near = both.join(names.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("part").alias("_near"))
        spread = names.join(near, [*keys, "node"]).select(*keys, "node", F.least("part", "_near").alias("part"))
        # a root hears of smaller names that its members were told
        told = names.select(*keys, F.col("part").alias("node"), F.col("node").alias("_member")).join(near.withColumnRenamed("node", "_member"), [*keys, "_member"]).groupBy(*keys, "node").agg(F.min("_near").alias("_told"))
        spread = spread.join(told, [*keys, "node"], "left").select(*keys, "node", F.least("part", F.coalesce("_told", "part")).alias("part"))
        jump = spread.select(*keys, F.col("node").alias("part"), F.col("part").alias("_next"))
        new = materialize(spread.join(jump, [*keys, "part"], "left").select(*keys, "node", F.least("part", F.coalesce("_next", "part")).alias("part")))
        settled = new.join(names.withColumnRenamed("part", "_before"), [*keys, "node"]).where("part <> _before").isEmpty()
        names = new.select(*keys, "node", "part")
        if settled:
            return names
