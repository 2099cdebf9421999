"""Statistics over large frames: moments, ranks and tests.

Rows are reduced by Spark to moments or to counts by value; tails are computed on what is left, a row for each test.
Ranks come from counts by distinct value: the only ordered pass is over distinct values, which a global rank window over
rows would put into one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import tails
from assayer.shipping import ship


def _p(kind: str, *cols: Column) -> Column:
    """A tail as a column of a small frame."""
    f = getattr(tails, kind)
    ship()

    @F.pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*series, strict=True)], dtype="float64")

    return tail(*[c.cast("double") for c in cols])


def with_mid_ranks(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Adds the mid-rank of a value within its group; nulls have none.

    Counts by value are ranked in two steps, so that no task sorts all of them: values are dealt into ranges, ranks run within
    a range, and ranges are offset by the counts before them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    dealt = counts.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = dealt.withColumn("_upto", F.sum("_n").over(within))
    sums = run.groupBy("_part", *by).agg(F.max("_upto").alias("_size"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    ranks = run.join(F.broadcast(offsets), ["_part", *by])
    ranks = ranks.select(*by, value, (F.col("_off") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value], "left")


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """by, n, r over rows with both values, for groups with at least `least` of them."""
    both = df.dropna(subset=[x, y])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).where(F.col("n") >= least)


def with_correlation_p(df: DataFrame) -> DataFrame:
    """Adds p of r by the t approximation and the 95 % interval by Fisher's z."""
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    z, half = F.atanh(r), F.lit(1.959963984540054) / F.sqrt(n - 3)
    return df.withColumns({"p": _p("t_two_sided", t, n - 2), "low": F.tanh(z - half), "high": F.tanh(z + half)})


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 4) -> DataFrame:
    """by, n, r: Pearson's r of mid-ranks."""
    both = df.dropna(subset=[x, y]).select(*by, x, y)
    ranked = with_mid_ranks(with_mid_ranks(both, x, by, "_rx"), y, by, "_ry")
    return pearson(ranked, "_rx", "_ry", by, least)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """a, b, r of all pairs over complete rows, in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k + 1 :]]
    wide = df.dropna(subset=list(cols)).agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance: n, k, f, eta2, p; from each group's count, mean and variance."""
    g = df.dropna(subset=[value, group]).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    n, m = F.col("n"), F.col("m")
    sums = g.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(n * m).alias("_s"), F.sum(n * m * m).alias("_q"), F.sum(n * F.col("v")).alias("_within")
    )
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    k = F.col("k")
    out = sums.withColumn("_between", between).withColumns({
        "f": (F.col("_between") / (k - 1)) / F.when(F.col("_within") != 0, F.col("_within") / (F.col("n") - k)),
        "eta2": F.col("_between") / F.when(F.col("_between") + F.col("_within") != 0, F.col("_between") + F.col("_within")),
    })
    return out.select(*by, "n", "k", "f", "eta2", _p("f_upper", F.col("f"), k - 1, F.col("n") - k).alias("p"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction: n, k, h, df, p."""
    rows = df.dropna(subset=[value, group]).select(value, group)
    g = with_mid_ranks(rows, value).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"))
    sums = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    ties = rows.groupBy(value).count().agg(F.sum(F.col("count").cast("double") * F.col("count") * F.col("count") - F.col("count")).alias("ties"))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n.cast("double") * n * n - n))
    out = sums.join(F.broadcast(ties)).select("n", "k", h.alias("h"), (F.col("k") - 1).alias("df"))
    return out.withColumn("p", _p("chi2_upper", F.col("h"), F.col("df")))


def wilcoxon_pairs(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rank-sum test of every pair of groups a < b: n1, n2, w, effect (rank-biserial), z, p, p_bonferroni.

    W counts the pairs of rows in which a's value is larger, ties half. It follows from counts by (group, value): for each
    value of a, the counts of b below and at it. The frame that pairs groups has the size of the distinct values.
    """
    counts = df.dropna(subset=[value, group]).groupBy(group, value).agg(F.count("*").cast("double").alias("n"))
    values = counts.select(value).distinct()
    names = counts.select(group).distinct()
    grid = values.join(F.broadcast(names)).join(counts, [value, group], "left").fillna(0.0, ["n"])
    low = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cum = grid.withColumn("below", F.coalesce(F.sum("n").over(low), F.lit(0.0)))
    one = cum.select(value, F.col(group).alias("a"), F.col("n").alias("na"))
    two = cum.select(value, F.col(group).alias("b"), F.col("n").alias("nb"), "below")
    met = one.join(two, value).where("a < b")
    both = F.col("na") + F.col("nb")
    agg = met.groupBy("a", "b").agg(
        F.sum("na").alias("n1"), F.sum("nb").alias("n2"),
        F.sum(F.col("na") * (F.col("below") + F.col("nb") / 2)).alias("w"),
        F.sum(both * both * both - both).alias("_ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n, mean = n1 + n2, n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    off = F.col("w") - mean
    z = (off - F.signum(off) * 0.5) / F.when(sd != 0, sd)
    out = agg.select("a", "b", "n1", "n2", "w", (1 - 2 * F.col("w") / (n1 * n2)).alias("effect"), z.alias("z"))
    out = out.withColumn("p", _p("normal_two_sided", F.col("z")))
    return bonferroni(out)


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn(f"{p}_bonferroni", F.least(F.lit(1.0), F.col(p) * F.count("*").over(Window.partitionBy())))


def two_samples(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """Welch's t, its degrees of freedom and p, and Cohen's d, of rows with and without a flag."""
    kept = df.where(F.col(value).isNotNull() & flag.isNotNull())
    agg = kept.agg(*[f(F.when(flag if side else ~flag, F.col(value))).alias(f"{name}{side}") for side in (0, 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, v0, v1 = F.col("n0"), F.col("n1"), F.col("v0"), F.col("v1")
    e0, e1 = v0 / n0, v1 / n1
    se = F.sqrt(e0 + e1)
    pooled = F.sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))
    diff = F.col("m1") - F.col("m0")
    out = agg.select(
        "n0", "n1", "m0", "m1", (diff / F.when(se != 0, se)).alias("t"),
        ((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1))).alias("df"),
        (diff / F.when(pooled != 0, pooled)).alias("d"),
    )
    return out.withColumn("p", _p("t_two_sided", F.col("t"), F.col("df")))


def trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    both = df.dropna(subset=[x, y])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def quartiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Exact quartiles, interpolated between neighbours."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("most"))
    return out.select(*by, "n", "least", *[F.col("_q")[k].alias(f"q{k + 1}") for k in range(3)], "most")


def proportion_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def half_width(n: int) -> float:
    """Half of the 95 % interval on Fisher's scale."""
    return 1.959963984540054 / math.sqrt(n - 3)
