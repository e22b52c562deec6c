"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, root): every node that has an edge, with the smallest
    node of its component.

    Alternating large and small stars: in each round every node hangs its
    larger neighbours, then its smaller ones, on its smallest neighbour, until
    nothing changes.  A star's smallest neighbour is a partial ``min``; a node with very
    many neighbours is never gathered.  Each round's edges are checkpointed.
    """
    def smallest(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.min("v").alias("m"))

    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
         .distinct().checkpoint())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest node of a star stays linked to the rest through its larger neighbours
        large = large.where("u <> v").distinct()
        low = smallest(large)
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))).where("u <> v").distinct().checkpoint()
        if small.count() == e.count() and small.exceptAll(e).isEmpty():
            break
        e = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
