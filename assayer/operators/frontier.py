"""Search along citations from the best seeds outwards, to a depth and a number of finds.

Level by level, all citations of the frontier are ordered by the rank of the citing node and their place in it. Of each cited
node the first citation counts: it decides by its context whether the node is of interest, and later ones change nothing. Nodes
that are known already are not found again, but the citation of them is told. Of the finds as many are kept as the cap leaves;
they are the next frontier, ranked in the order in which they were found.

Ranks come from ranges: the finds are sorted in ranges and pinned, so that a row's number within its range and the number of
the range are its rank. The cut at the cap needs the sizes of the ranges only, and the order within the one range that it falls
into; no task sees all rows, and the driver a number for each range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.sources.stored import written

#: The priority of the first level's finds, what each level takes off, and the least one.
FIRST_PRIORITY, STEP, LEAST_PRIORITY = 0.8, 0.1, 0.5


@dataclass
class Found:
    nodes: DataFrame  # node, depth, priority, cited_by, found_as (from 0, in the order of the finds)
    known: DataFrame  # node, cited_by, depth: first citations of nodes that were there


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with rank, a long that ascends in the order of columns, pinned in ranges of them."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.withColumns({"part": F.spark_partition_id(), "rank": F.monotonically_increasing_id()}))


def first_of(pinned: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The first rows of a ranked frame, most of them at most, with found_as (from 0); and how many there are."""
    sizes = sorted((r["part"], r["n"], r["least"]) for r in pinned.groupBy("part").agg(F.count("*").alias("n"), F.min("rank").alias("least")).collect())  # a row a range
    offsets, before = [], 0
    for part, n, least in sizes:
        offsets.append((part, before - least))
        before += n
    shift = pinned.sparkSession.createDataFrame(offsets, "part int, shift long")
    placed = pinned.join(F.broadcast(shift), "part").withColumn("found_as", F.col("rank") + F.col("shift")).drop("shift", "part")
    return placed.where(F.col("found_as") < most), min(most, before)


def explored(seeds: DataFrame, edges: DataFrame, context: Column | None = None, known: DataFrame | None = None, depth: int = 2, most: int = 100) -> Found:
    """Finds from seeds (node, seed_rank) along edges (src, place, dst and what context needs).

    known: node. Seeds are known. Null nodes and citations of null are left out; a node that is a seed twice has its lesser
    rank; equal (src, place) go by dst.
    """
    spark = seeds.sparkSession
    edges = edges.withColumn("_ok", F.coalesce(context, F.lit(False)) if context is not None else F.lit(True)).where("dst IS NOT NULL").select("src", "place", "dst", "_ok")
    start = seeds.where("node IS NOT NULL").groupBy("node").agg(F.min("seed_rank").alias("rank"))
    there = start.select("node") if known is None else start.select("node").unionByName(known.select("node")).where("node IS NOT NULL").distinct()
    there, frontier = written(there), start
    kind = dict(edges.dtypes)["dst"]
    found = spark.createDataFrame([], f"node {kind}, depth int, priority double, cited_by {dict(edges.dtypes)['src']}, found_as long")
    links = spark.createDataFrame([], f"node {kind}, cited_by {dict(edges.dtypes)['src']}, depth int")
    seen = spark.createDataFrame([], f"node {kind}")
    total = 0
    for level in range(1, depth + 1):
        if total >= most:
            break
        cited = frontier.select(F.col("node").alias("src"), "rank").join(edges, "src")
        order = F.struct("rank", "place", "src")
        first = cited.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(*[order[c].alias(c) for c in ("rank", "place", "src")], F.col("_ok"))).alias("at"))
        fresh = first.join(seen, "node", "left_anti").join(there.withColumn("_there", F.lit(True)), "node", "left")
        fresh = written(fresh.select("node", "at.rank", "at.place", "at.src", "at._ok", F.coalesce("_there", F.lit(False)).alias("_there")))
        links = links.unionByName(fresh.where("_there AND _ok").select("node", F.col("src").alias("cited_by"), F.lit(level).alias("depth")))
        pinned = ranked(fresh.where("_ok AND NOT _there").select("node", F.col("rank").alias("above"), "place", "src"), "above", "place", "node")
        kept, n = first_of(pinned, most - total)
        if not n:
            break
        priority = max(LEAST_PRIORITY, round(FIRST_PRIORITY - STEP * (level - 1), 6))
        found = found.unionByName(kept.select("node", F.lit(level).alias("depth"), F.lit(priority).alias("priority"), F.col("src").alias("cited_by"), (F.col("found_as") + total).alias("found_as")))
        frontier, total = kept.select("node", "rank"), total + n
        seen = seen.unionByName(fresh.select("node"))
    return Found(found, links)
