"""Citations and the work queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded(seeds: DataFrame, edges: DataFrame, depth: int = 2, known: DataFrame | None = None) -> DataFrame:
    """node, depth, priority of nodes reached from seeds within `depth` hops, the least depth of each; known nodes are left out.

    edges: src, dst. Every hop joins the frontier, not all that was found, and drops what was seen before. With contexts, a cap
    and an order of finds: frontier.explored.
    """
    frontier = seeds.select(F.col("node")).distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    out = seen.where("depth > 0")
    if known is not None:
        out = out.join(known.select("node"), "node", "left_anti")
    return out.withColumn("priority", F.greatest(F.lit(0.5), F.round(0.9 - 0.1 * F.col("depth"), 6)))


def degrees(edges: DataFrame) -> DataFrame:
    """node, cites, cited_by."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("cites"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("cited_by"))
    return out.join(into, "node", "full").fillna(0, ["cites", "cited_by"])


def new_rows(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore: candidates none of whose keys is there, the first of each key among themselves."""
    out = candidates
    for k in keys:
        out = out.join(existing.select(k).distinct(), k, "left_anti")
        w = Window.partitionBy(k).orderBy(*[c for c in candidates.columns])
        out = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out.select(*candidates.columns)


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the patch's non-null values."""
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return rows.join(p, key, "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns}).drop(*[f"_p_{c}" for c in columns])


def next_in_queue(queue: DataFrame, status: str, k: int, tie: str) -> DataFrame:
    """The k rows of a status with the highest priority; rows without one come last."""
    return queue.where(F.col("status") == status).orderBy(F.desc_nulls_last("priority_score"), tie).limit(k)


def quota_by_group(df: DataFrame, group: str, order: Sequence[Column], quota: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota).drop("_rn")


def yearly_sweep(df: DataFrame, year: str, order: Sequence[Column], years: int, most: int) -> DataFrame:
    """At most max(1, most // years) rows of each year."""
    return quota_by_group(df, year, order, max(1, most // max(1, years)))


def decided(df: DataFrame, filters: Sequence[tuple[str, Column, Column]], base: str) -> DataFrame:
    """reason: the first filter (reason, passes, bonus) that a row fails, null if none; score: base and the bonuses before it, in 0..1."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok, _ in filters])
    score, open_ = F.col(base), F.lit(True)
    for _, ok, bonus in filters:
        open_ = open_ & F.coalesce(ok, F.lit(False))
        score = score + F.when(open_, bonus).otherwise(0.0)
    return df.withColumns({"reason": reason, "score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))})


def query_terms(first: DataFrame, second: DataFrame, required: str = "") -> DataFrame:
    """Every pair of two short term lists as a query."""
    pairs = first.select(F.col("term").alias("a")).join(F.broadcast(second.select(F.col("term").alias("b"))))
    return pairs.select(F.trim(F.concat_ws(" ", "a", "b", F.lit(required))).alias("query"))


def assigned_worker(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Even shares of rows by hash of the key: no global numbering."""
    return df.withColumn("worker", F.pmod(F.xxhash64(key), F.lit(workers)))
