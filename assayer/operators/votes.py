"""Several raters: majority votes, dissent and agreement."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(raters: Sequence[str], tie: str = "first") -> Column:
    """The vote of at least two of three raters, null unless all voted. A three-way split goes to the first rater, or to the median vote."""
    a, b, c = (F.col(r) for r in raters)
    lone = a if tie == "first" else F.array_sort(F.array(a, b, c))[1]
    vote = F.when(b == c, b).when((a == b) | (a == c), a).otherwise(lone)
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), vote)


def three_way_tie(raters: Sequence[str]) -> Column:
    a, b, c = (F.col(r) for r in raters)
    return (a != b) & (b != c) & (a != c)


def mean_vote(raters: Sequence[str]) -> Column:
    total = sum((F.col(r) for r in raters[1:]), F.col(raters[0]))
    return F.round(total / len(raters), 3)


def first_mode(raters: Sequence[str]) -> Column:
    """The most frequent vote of any number of raters; of equals the one that was cast first. Nulls do not vote."""
    votes = F.array_compact(F.array(*[F.col(r) for r in raters]))
    ranked = F.transform(votes, lambda v, k: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("n"), k.alias("k"), v.alias("v")))
    return F.array_min(ranked)["v"]


def with_votes(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    return df.withColumns({"majority": majority(raters), "three_way_tie": three_way_tie(raters), "mean_score": mean_vote(raters)})


def agreement(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """pair, n, rate for each pair of raters and for all together, in one pass."""
    pairs = [(f"{a}~{b}", F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) == F.col(b)) for a, b in combinations(raters, 2)]
    known, same = F.lit(True), F.lit(True)
    for r in raters:
        known, same = known & F.col(r).isNotNull(), same & (F.col(r) == F.col(raters[0]))
    pairs.append(("all", known, same))
    wide = df.agg(*[x for k, (_, ok, eq) in enumerate(pairs) for x in (F.sum(ok.cast("long")).alias(f"n{k}"), F.avg(F.when(ok, eq.cast("double"))).alias(f"r{k}"))])
    rows = F.array(*[F.struct(F.lit(name).alias("pair"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("rate")) for k, (name, _, _) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def evaluator_grid(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """a, b, rate for all ordered pairs of raters, each with itself too: counts of two columns at a time, no self-join."""
    cells = [(a, b, F.avg(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) == F.col(b)).cast("double")))) for a in raters for b in raters]
    wide = df.agg(*[x.alias(f"c{k}") for k, (_, _, x) in enumerate(cells)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("rate")) for k, (a, b, _) in enumerate(cells)])))


def binary_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rate over rows where both said 0 or 2."""
    both = df.where(F.col(a).isin(0, 2) & F.col(b).isin(0, 2))
    return both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("rate"))


def dissent(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Rows where the raters were not unanimous, with the dissenter of 2-1 splits, its vote and the majority's."""
    a, b, c = raters
    voted = df.dropna(subset=list(raters)).where(~((F.col(a) == F.col(b)) & (F.col(b) == F.col(c))))
    who = F.when(F.col(b) == F.col(c), a).when(F.col(a) == F.col(c), b).when(F.col(a) == F.col(b), c)
    minor = F.when(F.col(b) == F.col(c), F.col(a)).when(F.col(a) == F.col(c), F.col(b)).when(F.col(a) == F.col(b), F.col(c))
    return voted.withColumns({"dissenter": who, "minority_score": minor, "majority_score": F.when(who.isNotNull(), majority(raters))})


def minority_votes(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Dissents by rater; proportions are of all rows that were not unanimous, three-way splits included."""
    d = dissent(df, raters)
    total = d.agg(F.count("*").alias("_all"))
    counts = d.where("dissenter IS NOT NULL").groupBy("dissenter").agg(F.count("*").alias("votes"))
    return counts.join(F.broadcast(total)).withColumn("proportion", F.col("votes") / F.col("_all")).drop("_all")


def split_patterns(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    d = dissent(df, raters).where("dissenter IS NOT NULL")
    return d.groupBy(F.concat_ws("_", "dissenter", "minority_score", F.lit("vs"), "majority_score").alias("pattern")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts and percentages of (a, b) over rows with both."""
    counts = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("pct", 100 * F.col("n") / F.col("_all")).drop("_all")


def kappa(df: DataFrame, a: str, b: str, weighted: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa, plain or with quadratic weights, over rows with both ratings; null where chance agreement is full.

    All terms are moments: one aggregation over the confusion counts, with marginals by window over that small frame.
    """
    counts = df.dropna(subset=[a, b]).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    rows = counts.groupBy(*by, F.col(a).alias("_v")).agg(F.sum("n").alias("_ra"))
    cols = counts.groupBy(*by, F.col(b).alias("_w")).agg(F.sum("n").alias("_cb"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(_weight(F.col(a), F.col(b), weighted) * F.col("n")).alias("_o"))
    key = list(by)
    grid = rows.join(cols, key) if key else rows.join(F.broadcast(cols))
    expected = grid.groupBy(*by).agg(F.sum(_weight(F.col("_v"), F.col("_w"), weighted) * F.col("_ra") * F.col("_cb")).alias("_e"))
    met = total.join(expected, key) if key else total.join(F.broadcast(expected))
    off = F.col("_o") * F.col("n") / F.when(F.col("_e") != 0, F.col("_e"))
    return met.select(*by, "n", (1 - off).alias("kappa"))


def _weight(x: Column, y: Column, quadratic: bool) -> Column:
    """Disagreement of two ratings."""
    return ((x - y) * (x - y)).cast("double") if quadratic else (x != y).cast("double")


def bootstrap_kappa(df: DataFrame, a: str, b: str, key: str, samples: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """kappa of all rows and a percentile interval.

    Each replicate weights the rows by Poisson(1) draws from a hash of (seed, replicate, key): the bootstrap for distributed
    rows. Draws are summed to confusion counts before anything is shuffled, so replicates cost no copies of rows on the wire.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_r"), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, at, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        at += p
        weight = weight + (u > at).cast("int")
        p /= k
    drawn = df.dropna(subset=[a, b]).select(a, b, key, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_r"))
    counts = drawn.groupBy("_r", a, b).agg(F.sum(weight).alias("n")).where("n > 0")
    rows = counts.groupBy("_r", F.col(a).alias("_v")).agg(F.sum("n").alias("_ra"))
    cols = counts.groupBy("_r", F.col(b).alias("_w")).agg(F.sum("n").alias("_cb"))
    seen = counts.groupBy("_r").agg(F.sum("n").alias("n"), F.sum((F.col(a) != F.col(b)).cast("double") * F.col("n")).alias("_o"))
    chance = rows.join(cols, "_r").groupBy("_r").agg(F.sum((F.col("_v") != F.col("_w")).cast("double") * F.col("_ra") * F.col("_cb")).alias("_e"))
    each = seen.join(chance, "_r").select((1 - F.col("_o") * F.col("n") / F.when(F.col("_e") != 0, F.col("_e"))).alias("k"))
    ends = each.agg(F.percentile("k", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ci"))
    return kappa(df, a, b).join(F.broadcast(ends)).select("n", "kappa", F.col("_ci")[0].alias("low"), F.col("_ci")[1].alias("high"))


def self_bias(df: DataFrame, own: dict[str, str], raters: Sequence[str], model: str) -> DataFrame:
    """For each rater the mean of its votes on its own model's rows and of the other raters' there. own: rater to model name."""
    parts = []
    for r in raters:
        others = [o for o in raters if o != r]
        mean = sum((F.col(o) for o in others[1:]), F.col(others[0])) / len(others)
        mine = F.col(model) == own[r]
        parts.append(F.struct(F.lit(r).alias("rater"), F.avg(F.when(mine, F.col(r))).alias("own"), F.avg(F.when(mine, mean)).alias("others")))
    wide = df.dropna(subset=list(raters)).agg(F.array(*parts).alias("_rows"))
    return wide.select(F.inline("_rows")).withColumn("bias", F.col("own") - F.col("others"))


def transitions(df: DataFrame, old: str, new: str) -> DataFrame:
    """Counts of score changes and their share of the old score's rows."""
    counts = df.groupBy(old, new).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(old)))
