"""Vectors: normalisation and coherence of sequences. Top matches by cosine are in vector_index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(df: DataFrame, vector: str, name: str = "unit") -> DataFrame:
    """Adds the vector of length 1; null for the zero vector.

    The norm is bound as a lambda's argument: as a column of its own Spark would put its expression in for each element.
    """
    v = F.col(vector).cast("array<double>")
    return df.withColumn(name, let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def adjacent_coherence(vectors: Column) -> Column:
    """Mean cosine of neighbours in an array of unit vectors; null below two."""
    n = F.size(vectors)
    pairs = F.zip_with(F.slice(vectors, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(vectors, F.lit(2), F.greatest(n - 1, F.lit(0))), dot)
    return F.when(n >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (n - 1))


def mean_pairwise(df: DataFrame, unit: str, by: str, dims: int) -> DataFrame:
    """by, n, coherence: the mean cosine of all pairs of a group's unit vectors, from the length of their sum: linear in the rows."""
    sums = df.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.col(unit)[k]).alias(f"_s{k}") for k in range(dims)])
    square = F.lit(0.0)
    for k in range(dims):
        square = square + F.col(f"_s{k}") * F.col(f"_s{k}")
    n = F.col("n")
    return sums.select(by, "n", ((square - n) / F.when(n > 1, n * (n - 1))).alias("coherence"))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A vector of signed word counts by hash: deterministic, for use without an encoder."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slots = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    signs = F.transform(tokens, lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    pairs = F.arrays_zip(slots.alias("s"), signs.alias("v"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when(p["s"] == d, p["v"]).otherwise(0.0)))
