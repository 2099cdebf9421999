"""Runs of models over cases: deduplication, exclusion, leaderboards and profiles.

A run has run_id, case_id, llm_name, started_at, a score on 0/1/2, and measures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_score(runs: DataFrame, primary: str, original: str, name: str = "score") -> DataFrame:
    """The preferred score, on 0 to 1."""
    return runs.withColumn(name, F.coalesce(primary, original) / F.lit(2.0))


def large_groups(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows. The group sizes are small, so no row is shuffled for them."""
    sizes = df.groupBy(*keys).count().where(F.col("count") >= least).drop("count")
    return df.join(sizes, list(keys), "left_semi")


def first_runs(runs: DataFrame, keys: Sequence[str] = ("case_id", "llm_name"), at: str = "started_at", tie: str = "run_id") -> DataFrame:
    """The first run of each key; runs without a time come last, ties go to the lesser id."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(at), F.asc(tie))
    return runs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repeated(runs: DataFrame, keys: Sequence[str], least: int = 2, at: str = "started_at", tie: str = "run_id") -> DataFrame:
    """Runs of keys that have at least `least` of them, numbered run_num from 1."""
    part = Window.partitionBy(*keys)
    order = part.orderBy(F.asc_nulls_last(at), F.asc(tie))
    return runs.withColumns({"_n": F.count("*").over(part), "run_num": F.row_number().over(order)}).where(F.col("_n") >= least).drop("_n")


def case_scores(runs: DataFrame, score: str = "score", valid: str = "score_valid") -> DataFrame:
    """n, valid runs, runs above 0 and the best score of each case; an invalid score counts as 0."""
    counted = F.when(F.col(valid), F.col(score)).otherwise(F.lit(0.0))
    return runs.groupBy("case_id").agg(
        F.count("*").alias("n_runs"),
        F.sum(F.coalesce(F.col(valid), F.lit(False)).cast("long")).alias("n_valid"),
        F.sum(F.when(counted > 0, 1).otherwise(0)).alias("n_above_zero"),
        F.max(counted).alias("best"),
    )


def without_hopeless_cases(runs: DataFrame, score: str = "score", valid: str = "score_valid") -> DataFrame:
    """Valid runs of the cases that some run solved at least in part."""
    hopeless = case_scores(runs, score, valid).where("n_above_zero = 0").select("case_id")
    return runs.where(F.col(valid)).join(hopeless, "case_id", "left_anti")


def share(condition: Column) -> Column:
    """Mean of a condition over the rows where it is known."""
    return F.avg(condition.cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom is zero."""
    return top / F.when(bottom != 0, bottom)


def model_summary(runs: DataFrame, by: Sequence[str], score: str, measures: Sequence[str], cost: str | None = None) -> DataFrame:
    """n, mean score, shares of full, half and no score, means of measures; cost_per_defensible: the full-score runs' cost over their number."""
    s = F.col(score)
    aggs = [
        F.count("*").alias("n"),
        F.avg(s).alias("mean_score"),
        share(s == 1.0).alias("p_full"),
        share(s == 0.5).alias("p_half"),
        share(s == 0.0).alias("p_none"),
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
    ]
    if cost:
        aggs.append(ratio(F.sum(F.when(s == 1.0, F.coalesce(F.col(cost), F.lit(0.0)))), F.sum(F.when(s == 1.0, 1).otherwise(0))).alias("cost_per_defensible"))
    return runs.groupBy(*by).agg(*aggs)


def cost_per_defensible_by_rates(runs: DataFrame, by: Sequence[str], score: str, cost: str) -> DataFrame:
    """The other definition: the mean of costs above zero over the share of full scores. Not the same number."""
    mean = F.avg(F.when(F.col(cost) > 0, F.col(cost)))
    return runs.groupBy(*by).agg(ratio(mean, share(F.col(score) == 1.0)).alias("cost_per_defensible"))


def with_cost(runs: DataFrame, costs: DataFrame, on: str = "run_id", fill: Sequence[str] = ()) -> DataFrame:
    """Runs with their costs; a run without any costs nothing, a run with several rows of cost fans out."""
    joined = runs.join(costs, on, "left")
    return joined.fillna(0, list(fill)) if fill else joined


def category_summary(runs: DataFrame, by: Sequence[str], score: str, least: int) -> DataFrame:
    """n, distinct cases and mean score of categories with at least `least` runs; null categories drop."""
    kept = runs.dropna(subset=list(by))
    out = kept.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"), F.avg(score).alias("mean_score"))
    return out.where(F.col("n") >= least)


def excluded_cases(runs: DataFrame, kinds: Sequence[str], kind: str = "malpractice_type") -> DataFrame:
    """case_id of cases all of whose runs have an excluded kind."""
    hit = F.coalesce(F.col(kind).isin(*kinds), F.lit(False))
    return runs.groupBy("case_id").agg(F.bool_and(hit).alias("_all")).where("_all").select("case_id")


def pairs_of_runs(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, first, second: the values of the first two runs of each key that has two."""
    two = repeated(runs, keys).where("run_num <= 2")
    return two.groupBy(*keys).agg(
        F.max(F.when(F.col("run_num") == 1, F.col(value))).alias("first"),
        F.max(F.when(F.col("run_num") == 2, F.col(value))).alias("second"),
    )


def summary_with_total(df: DataFrame, by: str, aggs: Sequence[Column]) -> DataFrame:
    """Groups and a TOTAL row; null groups are "unknown"."""
    filled = df.withColumn(by, F.coalesce(F.col(by), F.lit("unknown")))
    out = filled.rollup(by).agg(F.grouping(by).alias("_total"), *aggs)
    return out.withColumn(by, F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(by))).drop("_total")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by columns, zeros filled, with a row total. Naming the values saves a pass over the data."""
    wide = df.groupBy(row).pivot(column, list(values)).count().fillna(0, list(values))
    total = F.lit(0)
    for v in values:
        total = total + F.col(f"`{v}`")
    return wide.withColumn("total", total)


def pareto_front(df: DataFrame, cost: str, score: str, name: str) -> DataFrame:
    """Rows whose score is the running maximum over ascending cost. For small, aggregated frames: it has one partition."""
    w = Window.orderBy(F.asc(cost), F.asc(name)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_top", F.max(score).over(w)).where(F.col(score) >= F.col("_top")).drop("_top")


def min_max(df: DataFrame, axes: Sequence[str], inverted: Sequence[str] = ()) -> DataFrame:
    """Axes scaled to 0..1 over all rows, null where all are equal. The extremes are one row, joined by broadcast."""
    names = [*axes, *inverted]
    ends = df.agg(*[f(a).alias(f"_{k}_{a}") for a in names for k, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(F.broadcast(ends))
    for a in names:
        lo, hi = F.col(f"_lo_{a}"), F.col(f"_hi_{a}")
        up = (hi - F.col(a)) if a in inverted else (F.col(a) - lo)
        joined = joined.withColumn(f"{a}_scaled", up / F.when(hi != lo, hi - lo))
    return joined.drop(*[f"_{k}_{a}" for a in names for k in ("lo", "hi")])


def top_with_ties(df: DataFrame, by: Sequence[str], value: str, top: bool = True) -> DataFrame:
    """All rows with the largest (or least) value of each group."""
    best = df.groupBy(*by).agg((F.max if top else F.min)(value).alias("_best"))
    return df.join(best, list(by)).where(F.col(value) == F.col("_best")).drop("_best")


def share_within(df: DataFrame, group: str, item: str) -> DataFrame:
    """Counts of items, their share of their group and of all."""
    counts = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return counts.withColumns({
        "share": F.col("n") / F.sum("n").over(Window.partitionBy(group)),
        "share_of_all": F.col("n") / F.sum("n").over(Window.partitionBy()),
    })


def qa_metrics(runs: DataFrame) -> DataFrame:
    """One row: runs, missing values, and the score histogram with zeros for absent scores."""
    s = F.col("score_0_2")
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.sum(s.isNull().cast("long")).alias("null_scores"),
        F.sum(F.col("started_at").isNull().cast("long")).alias("null_started"),
        F.round(100 * share(s.isNull()), 2).alias("pct_null_scores"),
        *[F.sum(F.when(s == k, 1).otherwise(0)).alias(f"score_{k}") for k in (0, 1, 2)],
    )
