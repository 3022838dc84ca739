"""Connected components of links, by alternating min-label rounds, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node of its component.

    Large-star and small-star rounds: each joins every node's neighbours to their smallest, so that chains shrink
    by half and hubs never carry more than their own edges. Lineage is cut every round.
    """
    both = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).where("a is not null and b is not null and a != b")
    now = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        # large star: larger neighbours point to the smallest of the neighbourhood
        out = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = out.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        # small star: smaller neighbours and the node itself point to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
        now = cut(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen.n, seen.h):
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError("the components did not settle")
    leaves = now.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    roots = now.select(F.col("a").alias("node")).distinct().join(leaves.select("node"), "node", "left_anti").withColumn("root", F.col("node"))
    return leaves.unionByName(roots)
