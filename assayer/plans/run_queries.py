"""Queries over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions import ladders
from assayer.operators import runs as R
from assayer.plans.tables import RUNS, read, runs

#: Display names by pattern, the first match wins.
NAMES = (("purch", "Buyer"), ("^view$", "Viewer"), ("click|sign", "Actor"))
EXCLUDED = ("kind_3",)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runs(spark, sf_dir).where(ladders.excluded(F.col("malpractice_type"), EXCLUDED))
    return R.with_score(R.large_groups(kept, ["llm_name"], 20), "primary_score", "score_0_2")


PREPARED = f"""{RUNS},
kept AS (SELECT * FROM runs WHERE malpractice_type IS NULL OR malpractice_type <> 'kind_3'),
prepared AS (
  SELECT *, coalesce(primary_score, score_0_2) / 2.0 AS score FROM kept
  WHERE llm_name IN (SELECT llm_name FROM kept GROUP BY llm_name HAVING count(*) >= 20)),
firsts AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, llm_name ORDER BY started_at NULLS LAST, run_id) AS rn FROM prepared) WHERE rn = 1),
solved AS (
  SELECT * FROM firsts WHERE score_valid AND case_id NOT IN (
    SELECT case_id FROM firsts GROUP BY case_id HAVING count(*) FILTER (score_valid AND score > 0) = 0))"""


def leaderboard(spark, sf_dir):
    solved = R.without_hopeless_cases(R.first_runs(_prepared(spark, sf_dir)))
    out = R.model_summary(solved, ["llm_name"], "score", ["recommendation_length"], "cost")
    names = ladders.ladder(F.col("llm_name"), NAMES, "Other")
    rounded = {c: F.round(c, 6) for c in ("mean_score", "p_full", "p_half", "p_none", "mean_recommendation_length", "cost_per_defensible")}
    return out.withColumns({"display": names, **rounded}).orderBy(F.desc("mean_score"), "llm_name")


def first_run_dedupe(spark, sf_dir):
    return R.first_runs(_prepared(spark, sf_dir)).select("run_id", "case_id", "llm_name")


def case_score_summary(spark, sf_dir):
    return R.case_scores(R.first_runs(_prepared(spark, sf_dir)))


def retest_pairs(spark, sf_dir):
    pairs = R.pairs_of_runs(_prepared(spark, sf_dir), ["case_id", "llm_name"], "score")
    return pairs.groupBy("first", "second").agg(F.count("*").alias("n"))


def duplicate_pairs(spark, sf_dir):
    twice = runs(spark, sf_dir).groupBy("case_id", "llm_name").count().where("count > 1")
    return twice.agg(F.count("*").alias("n_pairs"), F.sum("count").alias("n_runs"))


def category_summary(spark, sf_dir):
    out = R.category_summary(_prepared(spark, sf_dir), ["malpractice_type"], "score", 10)
    return out.withColumns({"mean_score": F.round("mean_score", 6), "label": ladders.titled(F.col("malpractice_type"))}).drop("malpractice_type")


def heat_map(spark, sf_dir):
    out = R.category_summary(_prepared(spark, sf_dir), ["llm_name", "malpractice_type"], "score", 2)
    return out.withColumn("mean_score", F.round("mean_score", 6))


def cpdr_variants(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    one = R.model_summary(p, ["llm_name"], "score", [], "cost").select("llm_name", F.round("cost_per_defensible", 4).alias("by_sums"))
    two = R.cost_per_defensible_by_rates(p, ["llm_name"], "score", "cost").select("llm_name", F.round("cost_per_defensible", 4).alias("by_rates"))
    return one.join(two, "llm_name")


def summary_total(spark, sf_dir):
    aggs = [F.count("*").alias("n"), F.round(F.avg("score_0_2"), 6).alias("mean_score")]
    return R.summary_with_total(runs(spark, sf_dir), "malpractice_type", aggs)


def category_pivot(spark, sf_dir):
    return R.pivot_counts(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def unpivot_profile(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    long = line.select("l_returnflag", "l_quantity", "l_discount", "l_tax").unpivot(["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "measure", "v")
    named = long.withColumn("measure", F.regexp_replace("measure", "^l_", ""))
    return named.groupBy("l_returnflag", "measure").agg(F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))


def pareto_front(spark, sf_dir):
    means = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("cost"), F.count("*").alias("score"))
    return R.pareto_front(means, "cost", "score", "c_nationkey")


def minmax_axes(spark, sf_dir):
    part = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg("p_size"), 4).alias("size"))
    out = R.min_max(part, ["size"], ["price"])
    return out.withColumns({c: F.round(c, 8) + 0.0 for c in ("size_scaled", "price_scaled")})


def top_ties(spark, sf_dir):
    return R.top_with_ties(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size")


def share_within_group(spark, sf_dir):
    out = R.share_within(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return out.withColumns({"share": F.round("share", 8), "share_of_all": F.round("share_of_all", 8)})


def qa_metrics(spark, sf_dir):
    return R.qa_metrics(runs(spark, sf_dir))


def bool_and_exclusion(spark, sf_dir):
    """Customers all of whose orders are of two statuses."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderstatus")
    return R.excluded_cases(orders, ["F", "P"], "o_orderstatus")


def verbosity_buckets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    return docs.groupBy("lang", ladders.verbosity(F.col("n")).alias("bucket")).agg(F.count("*").alias("docs"), F.median("n").alias("median_length"))


def difficulty(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    by_case = p.groupBy("case_id").agg(F.countDistinct("llm_name").alias("models"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("solved"))
    return by_case.groupBy("models", "solved").agg(F.count("*").alias("cases"))


def exclusion_rate(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy("jurisdiction").agg(F.round(100 * F.avg(F.coalesce(F.col("malpractice_type").isin(*EXCLUDED), F.lit(False)).cast("double")), 4).alias("pct"), F.count("*").alias("n"))
    return r.where("n >= 10").orderBy(F.desc("pct"), "jurisdiction").limit(12)


def liability_codes(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("code", ladders.liability_code(F.col("score_0_2"), F.col("run_id") % 29 == 0))
    return r.groupBy("code").agg(F.count("*").alias("n"))


def scored_costs(spark, sf_dir):
    """Runs with the cost of their orders; a run without an order costs nothing."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    out = R.with_cost(runs(spark, sf_dir).select("run_id", "llm_name"), orders, fill=["spent"])
    return out.groupBy("llm_name").agg(F.count("*").alias("n"), F.round(F.sum("spent"), 1).alias("spent"), F.sum((F.col("spent") == 0).cast("long")).alias("without"))


QUERIES = {
    "leaderboard": leaderboard, "first_run_dedupe": first_run_dedupe, "case_score_summary": case_score_summary,
    "retest_pairs": retest_pairs, "duplicate_pairs": duplicate_pairs, "category_summary": category_summary, "heat_map": heat_map,
    "cpdr_variants": cpdr_variants, "summary_total": summary_total, "category_pivot": category_pivot, "unpivot_profile": unpivot_profile,
    "pareto_front": pareto_front, "minmax_axes": minmax_axes, "top_ties": top_ties, "share_within_group": share_within_group,
    "qa_metrics": qa_metrics, "bool_and_exclusion": bool_and_exclusion, "verbosity_buckets": verbosity_buckets,
    "difficulty": difficulty, "exclusion_rate": exclusion_rate, "liability_codes": liability_codes, "scored_costs": scored_costs,
}

ORACLES = {
    "leaderboard": f"""WITH {PREPARED}
SELECT llm_name, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg((score = 1)::INT), 6) AS p_full,
       round(avg((score = 0.5)::INT), 6) AS p_half, round(avg((score = 0)::INT), 6) AS p_none,
       round(avg(recommendation_length), 6) AS mean_recommendation_length,
       round(sum(cost) FILTER (score = 1) / nullif(count(*) FILTER (score = 1), 0), 6) AS cost_per_defensible,
       CASE WHEN llm_name LIKE '%purch%' THEN 'Buyer' WHEN llm_name = 'view' THEN 'Viewer'
            WHEN llm_name LIKE '%click%' OR llm_name LIKE '%sign%' THEN 'Actor' ELSE 'Other' END AS display
FROM solved GROUP BY llm_name""",
    "first_run_dedupe": f"WITH {PREPARED} SELECT run_id, case_id, llm_name FROM firsts",
    "case_score_summary": f"""WITH {PREPARED}
SELECT case_id, count(*) AS n_runs, count(*) FILTER (score_valid)::BIGINT AS n_valid,
       count(*) FILTER (score_valid AND score > 0)::BIGINT AS n_above_zero, max(CASE WHEN score_valid THEN score ELSE 0.0 END) AS best
FROM firsts GROUP BY case_id""",
    "retest_pairs": f"""WITH {PREPARED},
t AS (SELECT *, row_number() OVER (PARTITION BY case_id, llm_name ORDER BY started_at NULLS LAST, run_id) AS k,
      count(*) OVER (PARTITION BY case_id, llm_name) AS m FROM prepared),
p AS (SELECT case_id, llm_name, max(score) FILTER (k = 1) AS first, max(score) FILTER (k = 2) AS second
      FROM t WHERE m >= 2 AND k <= 2 GROUP BY ALL)
SELECT first, second, count(*) AS n FROM p GROUP BY ALL""",
    "duplicate_pairs": f"WITH {RUNS} SELECT count(*) AS n_pairs, sum(n)::BIGINT AS n_runs FROM (SELECT count(*) AS n FROM runs GROUP BY case_id, llm_name HAVING count(*) > 1)",
    "category_summary": f"""WITH {PREPARED}
SELECT 'Kind ' || substr(malpractice_type, 6) AS label, count(*) AS n, count(DISTINCT case_id) AS n_cases, round(avg(score), 6) AS mean_score
FROM prepared WHERE malpractice_type IS NOT NULL GROUP BY malpractice_type HAVING count(*) >= 10""",
    "heat_map": f"""WITH {PREPARED}
SELECT llm_name, malpractice_type, count(*) AS n, count(DISTINCT case_id) AS n_cases, round(avg(score), 6) AS mean_score
FROM prepared WHERE malpractice_type IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "cpdr_variants": f"""WITH {PREPARED}
SELECT llm_name, round(sum(cost) FILTER (score = 1) / count(*) FILTER (score = 1), 4) AS by_sums,
       round((avg(cost) FILTER (cost > 0)) / avg((score = 1)::INT), 4) AS by_rates FROM prepared GROUP BY llm_name""",
    "summary_total": f"""WITH {RUNS}
SELECT CASE WHEN grouping(m) = 1 THEN 'TOTAL' ELSE m END AS malpractice_type, count(*) AS n, round(avg(score_0_2), 6) AS mean_score
FROM (SELECT *, coalesce(malpractice_type, 'unknown') AS m FROM runs) GROUP BY ROLLUP (m)""",
    "category_pivot": """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
       count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total FROM orders GROUP BY 1""",
    "unpivot_profile": """SELECT l_returnflag, substr(m, 3) AS measure, round(avg(v), 6) AS mean, max(v) AS most
FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME m VALUE v) GROUP BY ALL""",
    "pareto_front": """WITH m AS (SELECT c_nationkey, round(avg(c_acctbal), 4) AS cost, count(*) AS score FROM customer GROUP BY 1)
SELECT c_nationkey, cost, score FROM (
  SELECT *, max(score) OVER (ORDER BY cost, c_nationkey ROWS UNBOUNDED PRECEDING) AS t FROM m) WHERE score >= t""",
    "minmax_axes": """WITH m AS (SELECT p_brand, round(avg(p_retailprice), 4) AS price, round(avg(p_size), 4) AS size FROM part GROUP BY 1)
SELECT *, round((size - min(size) OVER ()) / nullif(max(size) OVER () - min(size) OVER (), 0), 8) + 0.0 AS size_scaled,
       round((max(price) OVER () - price) / nullif(max(price) OVER () - min(price) OVER (), 0), 8) + 0.0 AS price_scaled FROM m""",
    "top_ties": "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1",
    "share_within_group": """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 8) AS share, round(n / sum(n) OVER (), 8) AS share_of_all FROM c""",
    "qa_metrics": f"""WITH {RUNS}
SELECT count(*) AS n_runs, count(*) FILTER (score_0_2 IS NULL)::BIGINT AS null_scores, count(*) FILTER (started_at IS NULL)::BIGINT AS null_started,
       round(100 * avg((score_0_2 IS NULL)::INT), 2) AS pct_null_scores, count(*) FILTER (score_0_2 = 0)::BIGINT AS score_0,
       count(*) FILTER (score_0_2 = 1)::BIGINT AS score_1, count(*) FILTER (score_0_2 = 2)::BIGINT AS score_2 FROM runs""",
    "bool_and_exclusion": "SELECT o_custkey AS case_id FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus IN ('F', 'P'))",
    "verbosity_buckets": """SELECT lang, CASE WHEN n < 1000 THEN '<1k' WHEN n < 2500 THEN '1-2.5k' WHEN n < 5000 THEN '2.5-5k' WHEN n < 10000 THEN '5-10k' ELSE '>10k' END AS bucket,
       count(*) AS docs, median(n)::DOUBLE AS median_length FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY ALL""",
    "difficulty": f"""WITH {PREPARED},
c AS (SELECT case_id, count(DISTINCT llm_name) AS models, count(*) FILTER (score > 0)::BIGINT AS solved FROM prepared GROUP BY 1)
SELECT models, solved, count(*) AS cases FROM c GROUP BY ALL""",
    "exclusion_rate": f"""WITH {RUNS}
SELECT jurisdiction, round(100 * avg((coalesce(malpractice_type, '') = 'kind_3')::INT), 4) AS pct, count(*) AS n
FROM runs GROUP BY 1 HAVING count(*) >= 10 ORDER BY pct DESC, 1 LIMIT 12""",
    "liability_codes": f"""WITH {RUNS}
SELECT CASE WHEN run_id % 29 = 0 OR score_0_2 = 0 THEN 2 WHEN score_0_2 = 1 THEN 1 ELSE 0 END AS code, count(*) AS n FROM runs GROUP BY 1""",
    "scored_costs": f"""WITH {RUNS},
o AS (SELECT o_custkey AS run_id, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1)
SELECT llm_name, count(*) AS n, round(sum(coalesce(spent, 0)), 1) AS spent, count(*) FILTER (coalesce(spent, 0) = 0)::BIGINT AS without
FROM runs LEFT JOIN o USING (run_id) GROUP BY 1""",
}
