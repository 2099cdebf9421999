"""Procedures, codes and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.ladders import match_confidence


def extracted_procedures(texts: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, category, keyword: for each name of an ordered keyword table (ordinal, keyword, name, category) the first keyword that a text contains.

    The table is configuration of fixed size and travels in one array, so texts are never joined with keywords row by row.
    """
    table = keywords.agg(F.array_sort(F.collect_list(F.struct("ordinal", "keyword", "name", "category"))).alias("_kw"))
    low = texts.select(key, F.lower(text).alias("_t")).join(F.broadcast(table))
    hits = low.select(key, F.explode(F.filter("_kw", lambda k: F.col("_t").contains(F.lower(k["keyword"])))).alias("h"))
    return hits.groupBy(key, F.col("h.name").alias("name")).agg(F.min("h").alias("h")).select(key, "name", F.col("h.category").alias("category"), F.col("h.keyword").alias("keyword"))


def priced(wanted: DataFrame, prices: DataFrame, code: str = "code", plan: str = "plan") -> DataFrame:
    """The price row of each wanted (code, plan): of that plan if there is one, else of the plan loaded first.

    prices: code, plan, load_ordinal and amounts. Later rows of the same code and plan replace the amounts but keep the place
    of the first. The lookup joins on the code alone against one row per code that holds its plans in an array, so a code's
    many plans do not multiply the wanted rows.
    """
    amounts = [c for c in prices.columns if c not in (code, plan, "load_ordinal")]
    one = prices.where(F.col(code).isNotNull() & (F.col(code) != "") if dict(prices.dtypes)[code] == "string" else F.col(code).isNotNull())
    last = one.groupBy(code, plan).agg(F.min("load_ordinal").alias("_first"), F.max_by(F.struct(*amounts), "load_ordinal").alias("_a"))
    by_code = last.groupBy(code).agg(F.array_sort(F.collect_list(F.struct("_first", F.col(plan).alias("plan"), "_a"))).alias("_plans"))
    met = wanted.join(by_code, code, "left")
    exact = F.get(F.filter("_plans", lambda p: p["plan"].eqNullSafe(F.col(plan))), F.lit(0))
    chosen = F.coalesce(exact, F.get("_plans", F.lit(0)))
    return met.withColumn("_c", chosen).select(*wanted.columns, F.col("_c.plan").alias("price_plan"), *[F.col(f"_c._a.{a}").alias(a) for a in amounts])


def nonzero_sum(col: str | Column) -> Column:
    """Sum of values that are neither null nor zero; null if there is none: a price of zero is no price."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(F.when(c.isNotNull() & (c != 0), c))


def cost_totals(matched: DataFrame, by: Sequence[str], amounts: Sequence[str], matched_flag: str) -> DataFrame:
    hit = F.sum(F.col(matched_flag).cast("long"))
    n = F.count("*")
    return matched.groupBy(*by).agg(
        n.alias("procedure_count"),
        hit.alias("matched_count"),
        (hit / n).alias("match_rate"),
        *[nonzero_sum(a).alias(f"total_{a}") for a in amounts],
    )


def price_stats(prices: DataFrame, amount: str, code: str, plan: str) -> DataFrame:
    """One row: prices above zero, their extremes, median and mean, distinct codes and the sorted plans."""
    v = F.when(F.col(amount) > 0, F.col(amount))
    return prices.agg(
        F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.median(v).alias("median"), F.avg(v).alias("mean"),
        F.countDistinct(code).alias("codes"), F.array_join(F.sort_array(F.collect_set(plan)), ",").alias("plans"),
    )


def run_summary(totals: DataFrame, cost: str) -> DataFrame:
    """Share of runs with procedures, and statistics of the costs above zero."""
    c = F.when(F.col(cost) > 0, F.col(cost))
    return totals.agg(
        F.count("*").alias("runs"),
        F.avg((F.col("procedure_count") > 0).cast("double")).alias("with_procedures"),
        F.sum("procedure_count").alias("procedures"),
        F.avg(c).alias("mean_cost"),
        F.median(c).alias("median_cost"),
    )


def procedure_profile(procedures: DataFrame, by: str, run: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Means of procedures of each category a run, their total, and the shares of runs with any."""
    per_run = procedures.groupBy(by, run).agg(*[F.sum((F.col(category) == c).cast("long")).alias(c) for c in categories], F.count(category).alias("total"))
    return per_run.groupBy(by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in categories],
        *[F.format_string("%.1f%%", 100 * F.avg((F.col(c) > 0).cast("double"))).alias(f"with_{c}") for c in categories],
        F.avg("total").alias("mean_total"), F.median("total").alias("median_total"), F.max("total").alias("max_total"),
        F.count("*").alias("runs"),
    )


def top_procedures(procedures: DataFrame, name: str, cost: str, k: int = 20) -> DataFrame:
    """The most frequent names with their mean cost, in one aggregation; ties by name."""
    return procedures.groupBy(name).agg(F.count("*").alias("n"), F.avg(cost).alias("mean_cost")).orderBy(F.desc("n"), name).limit(k)


def with_confidence(matches: DataFrame, score: str) -> DataFrame:
    return matches.withColumn("match_confidence", match_confidence(F.col(score)))


def long_costs(summary: DataFrame, matched: str = "matched_costs") -> DataFrame:
    """A row for each matched cost of a nested summary."""
    rest = [c for c in summary.columns if c != matched]
    return summary.select(*rest, F.explode(matched).alias("_m")).select(*rest, "_m.*")


def latest(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key: upsert by union and latest wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(at), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
