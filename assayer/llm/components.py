"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node is linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """With edges from larger to smaller: a node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    linked = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """With edges from larger to smaller: whether each node either has one neighbour, a smaller one, or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) of every node of edges (a long, b long).

    Each round is two group-bys with map-side minima and two joins; the edge list is written after each round. It ends when
    the edges are stars around their least nodes, told by one group-by, so that no round is spent on finding no change.
    Self-links are dropped, so a node without another link is not returned; nor are nulls.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct())
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = written(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
