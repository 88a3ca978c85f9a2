"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import staged


def connected_components(edges: DataFrame, stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """(node, component) of every node of an edge (u, v), component being the least node that it reaches.

    Edges point from the greater node to the smaller. A round moves each edge's smaller end to that end's least smaller neighbour
    (large star), then each node to its least smaller neighbour, to which its others are tied too (small star). It ends when no
    edge moved and no node had two smaller neighbours, after a number of rounds that grows with the logarithm of the nodes. Each round is staged (``stage``) in the shared folder, and only a count comes to the
    driver. Minima are pre-aggregated, and joins by a hot node can be split.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        least = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        large = now.join(least, F.col("v") == F.col("c"), "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"), F.max("moved").alias("moved"))
        tied = large.join(small.filter("far > m").select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = small.select("u", F.col("m").alias("v"), (F.col("moved") | (F.col("far") > F.col("m"))).alias("busy")).unionByName(tied.withColumn("busy", F.lit(True)))
        after = stage(moved, "edges")
        now = after.select("u", "v")
        if not after.filter("busy").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
