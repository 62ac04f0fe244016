"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.session import written

MAX_ROUNDS = 100


def _hung(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    marks = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("top")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("top"))
    )
    per_node = marks.groupBy("u").agg(F.sum("down").alias("down"), F.max("top").alias("top"))
    return per_node.where("down > 1 OR (down > 0 AND top > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node it can reach.

    Each round hangs the larger neighbours of a node on its smallest one, then the
    smaller ones; edges never grow in number, and rounds with the logarithm of
    the nodes. Every round is written, so that a lost executor costs its tasks.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = written(down.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _hung(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
