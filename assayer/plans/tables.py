"""Stand-ins for the domain tables, made of the generic tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: users stand for cases and event types for models."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    value = F.floor(F.col("value")).cast("int")
    return e.select(
        k.alias("run_id"),
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("llm_name"),
        F.when(k % 13 != 0, F.col("ts")).alias("started_at"),
        F.when(k % 11 != 0, F.pmod(value, F.lit(3))).alias("score_0_2"),
        F.when(k % 5 == 0, F.pmod(value + 1, F.lit(3))).alias("primary_score"),
        (k % 7 != 0).alias("score_valid"),
        F.when(k % 17 != 0, F.concat(F.lit("kind_"), F.pmod(value, F.lit(4)).cast("string"))).alias("malpractice_type"),
        F.element_at(F.array(*[F.lit(x) for x in ("US", "UK", "CA", "NZ")]), (k % 4 + 1).cast("int")).alias("jurisdiction"),
        F.col("value").alias("cost"),
        (k % 900).alias("recommendation_length"),
    )


RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS case_id, event_type AS llm_name,
         CASE WHEN event_id % 13 <> 0 THEN ts END AS started_at,
         CASE WHEN event_id % 11 <> 0 THEN floor(value)::INT % 3 END AS score_0_2,
         CASE WHEN event_id % 5 = 0 THEN (floor(value)::INT + 1) % 3 END AS primary_score,
         event_id % 7 <> 0 AS score_valid,
         CASE WHEN event_id % 17 <> 0 THEN 'kind_' || (floor(value)::INT % 4) END AS malpractice_type,
         ['US', 'UK', 'CA', 'NZ'][event_id % 4 + 1] AS jurisdiction,
         value AS cost, event_id % 900 AS recommendation_length
  FROM events)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cases that three judges and a human rated 0, 1 or 2; some ratings are missing."""
    line, o, n = read(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    base = (F.col("l_partkey") + n) % 3
    return line.select(
        (o * 10 + n).alias("run_id"),
        F.col("l_returnflag").alias("llm_name"),
        F.when(o % 19 != 0, base).cast("int").alias("claude"),
        F.when(o % 23 != 0, F.when(F.col("l_suppkey") % 4 == 0, (base + 1) % 3).otherwise(base)).cast("int").alias("grok"),
        F.when(F.col("l_partkey") % 5 == 0, (base + 2) % 3).otherwise(base).cast("int").alias("gpt5"),
        F.when(n % 6 == 0, (base + 1) % 3).otherwise(base).cast("int").alias("human"),
    )


RATINGS = """ratings AS (
  SELECT l_orderkey * 10 + l_linenumber AS run_id, l_returnflag AS llm_name,
         (CASE WHEN l_orderkey % 19 <> 0 THEN b END)::INT AS claude,
         (CASE WHEN l_orderkey % 23 <> 0 THEN CASE WHEN l_suppkey % 4 = 0 THEN (b + 1) % 3 ELSE b END END)::INT AS grok,
         (CASE WHEN l_partkey % 5 = 0 THEN (b + 2) % 3 ELSE b END)::INT AS gpt5,
         (CASE WHEN l_linenumber % 6 = 0 THEN (b + 1) % 3 ELSE b END)::INT AS human
  FROM (SELECT *, (l_partkey + l_linenumber) % 3 AS b FROM lineitem))"""
