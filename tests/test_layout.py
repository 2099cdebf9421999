"""Exported tables join without a shuffle, hold 30 columns and 0/1 truths, and refuse a run twice."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from assayer.sources import layout


def tables(spark, n=200):
    runs = spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("run_id"), (F.col("id") % 7).cast("string").alias("case_id"), F.lit("m").alias("llm_name"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 3 == 1).alias("risk_flag"), F.lit(True).alias("score_valid"), F.lit(2).alias("primary_score"),
    )
    criteria = spark.range(3 * n).select(F.concat(F.lit("r"), (F.col("id") % (n + 10)).cast("string")).alias("run_id"), F.col("id").cast("string").alias("criterion"), (F.col("id") % 2 == 0).alias("met"))
    return runs, criteria


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_has_no_exchange(spark, tmp_path):
    runs, criteria = tables(spark)
    prefix = f"t{uuid.uuid4().hex}"
    made = layout.export_tables(runs, criteria, str(tmp_path), prefix, buckets=4)
    both = layout.joined(spark, made)
    assert "SortMergeJoin" in plan_of(both) and "Exchange" not in plan_of(both)
    assert "Exchange" not in plan_of(both.groupBy("run_id").agg(F.sum("met")))
    want = runs.join(criteria, "run_id")
    assert both.count() == want.count() and both.agg(F.sum("met")).first()[0] == want.where("met").count()
    stored = spark.table(made.runs)
    assert len(stored.columns) == 30 and "primary_score" not in stored.columns
    assert {tuple(r) for r in stored.select("risk_flag", "score_valid").distinct().collect()} == {(0, 1), (1, 1)}
    assert stored.where("risk_flag = 1").count() == runs.where("risk_flag").count()
    ids = [r["id"] for r in spark.table(made.criteria).select("id").collect()]
    assert sorted(ids) == list(range(1, 601))
    spark.sql(f"DROP TABLE {made.runs}")  # the catalog forgets, the files stay
    again = layout.joined(spark, layout.opened(spark, str(tmp_path), prefix, buckets=4))
    assert "Exchange" not in plan_of(again) and again.count() == want.count()


def test_export_replaces_and_refuses(spark, tmp_path):
    runs, criteria = tables(spark, 20)
    prefix = f"t{uuid.uuid4().hex}"
    layout.export_tables(runs, criteria, str(tmp_path), prefix, buckets=2)
    made = layout.export_tables(runs.limit(5), None, str(tmp_path), prefix, buckets=2)
    assert spark.table(made.runs).count() == 5 and spark.table(made.criteria).count() == 0
    with pytest.raises(ValueError, match=r"run_id r\d+ occurs 2 times"):
        layout.export_tables(runs.union(runs.limit(1)), criteria, str(tmp_path), prefix, buckets=2)
    nameless = runs.limit(2).withColumn("run_id", F.lit(None).cast("string"))
    made = layout.export_tables(runs.union(nameless), criteria, str(tmp_path), prefix, buckets=2)
    assert spark.table(made.runs).count() == 22 and layout.joined(spark, made).where("run_id IS NULL").count() == 0
    assert not re.search("Exchange", plan_of(layout.joined(spark, made)))
