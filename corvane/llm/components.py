"""Connected components of a graph whose edges are rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b: long): component is the smallest node it is linked to.

    Stars are alternated: every node hands its larger neighbours, then its smaller ones, to the smallest node
    it knows. Each round is joins on nodes, whose side with one row for each node meets the edges; a hub's many
    edges so can be split by adaptive execution. Rounds are checkpointed, and their number grows with the
    logarithm of the longest path. No edges give an empty table. Loops and repeated edges change nothing.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = common.durable(now)
    before = None
    while True:
        # large star: both directions, larger neighbours to the smallest node around
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = common.durable(small.where("u <> v").distinct())
        # done when every node has one edge, to its root, and the sums stay
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == before or not state[0]:
            break
        before = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component"), F.col("component")).distinct()).toDF("node", "component")
