"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: bigint); root is the component's smallest node.

    Each round is an aggregate and a join on the node, so a hub's rows can be split between tasks;
    the number of rounds grows with the logarithm of the longest path. Nulls and loops are ignored, repeated edges and both directions of one count
    once; no edges give no rows.
    """
    now = edges.select("a", "b").where("a <> b").distinct()
    for _ in range(max_rounds):
        # large star: every neighbour above u points to u's smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below point to the smallest of them; here v < u always
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = staged(small.where("a <> b").distinct(), "edges", 16)
        # done when each node has one edge to a root, and no root has an edge below
        ends = now.select(F.col("a").alias("u"), F.lit(1).alias("up")).union(now.select(F.col("b").alias("u"), F.lit(0).alias("up")))
        if ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("root")).where("ups > 1 or (ups = 1 and root = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
