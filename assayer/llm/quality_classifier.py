"""Quality classifier by positive-unlabelled learning.

Trusted positives and the unlabelled corpus give a score by the non-negative risk estimator (squared loss)

    R(g) = pi * Rp+(g) + max(0, Ru-(g) - pi * Rp-(g)) + ridge,

Negative labels are not used. Texts are described by indicator columns (shape measures cut at corpus quantiles) and by the
shares of their words and word pairs that fall into hash buckets. The loss is quadratic in the weights, so the risks depend on
the texts only through the first and second moments of the columns over the positives and over all documents. Spark sums these
exactly over every row, and the risk is minimised on moments of fixed size, whatever the input.

The class prior pi is estimated from positives and unlabelled rows: a first g is fitted to two thirds of the positives (by a
hash of their ids), and pi is the ratio of the shares of all documents and of the other positives above its best cut. The
outputs of the final g are cut at c, where documents are thinnest among the cuts above which about that share of all documents
lies. Both come from counts by bins of fixed number. The score is (g - c + 1) / 2 cut to 0..1.

Null and empty texts are scored like any other. Labels that are null or neither 0 nor 1 are ignored, repeated ones count
repeatedly; without any positive all scores are 1. Rows without an id are scored, never learned from as positives. Repeated
rows get equal scores; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import crc_mod, lower_ascii, map_lists, read, written

MEASURES = (
    "log_words", "mean_chars", "symbols", "bars", "marks", "capitals", "digits", "punctuation", "distinct_words",
    "repeated_next", "dup_lines", "words_per_line", "top_word", "short_words", "long_words", "distinct_pairs", "capital_words",
)
#: Hash buckets of words and of word pairs.
BUCKETS = 16
#: The least share of positives above a cut at which the prior is read off.
LEAST_ABOVE = 0.5
#: How far the share of rows above the cut may be from the prior, and the bins on each side in which rows are counted there.
SLACK, AROUND = 0.05, 5
QUANTILES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)
RIDGE = 1e-4
#: Edges of the bins in which the outputs of labelled rows are counted.
GRID = np.linspace(-3, 3, 601)


def shape(text: str | None) -> list[float]:
    """The MEASURES of one text, then the square roots of the shares of its words and of its pairs by hash bucket."""
    text = text or ""
    words = lower_ascii(text).split()
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * (len(MEASURES) + 2 * BUCKETS)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs = len(np.unique(ids[:-1] * len(known) + ids[1:])) if n > 1 else 1
    hashes = np.fromiter(map(zlib.crc32, known), np.int64, len(known))[ids]
    buckets = np.bincount(hashes % BUCKETS, minlength=BUCKETS) / n
    joint = np.bincount((hashes[:-1] * 31 + hashes[1:]) % 1_000_003 % BUCKETS, minlength=BUCKETS) / max(1, n - 1)
    upper = sum(map(str.isupper, text))
    letters = max(1, sum(map(str.isalpha, text)))
    caps = len(re.findall(r"\b[^\W\d_a-z]{2,}\b", text))
    count = text.count
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        sum(map(count, "#$%&*@^~")) / chars,
        count("|") / chars,
        count("!") / chars,
        upper / letters,
        sum(map(str.isdigit, text)) / chars,
        sum(map(count, ".,;:?")) / n,
        len(known) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        float(np.bincount(ids).max()) / n,
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        pairs / max(1, n - 1),
        caps / n,
        *np.sqrt(buckets),
        *np.sqrt(joint),
    ]


def shaped(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of shape(), of each row of docs (doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for rows in batches:
            yield {"doc_id": rows["doc_id"], "x": [shape(t) for t in rows["text"]]}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, x array<float>")


def cuts(rows: DataFrame) -> list[list[float]]:
    """Distinct quantiles of each measure over all documents."""
    cols = [F.percentile_approx(F.col("x")[k], list(QUANTILES), 2000).alias(f"q{k}") for k in range(len(MEASURES))]
    found = rows.agg(*cols).first()
    return [sorted(set(q)) if (q := found[f"q{k}"]) else [] for k in range(len(MEASURES))]


def columns_of(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """A constant, the bin indicators of each measure and the shares by bucket: rows by columns."""
    parts = [np.ones((len(x), 1))]
    for k, e in enumerate(edges):
        low = np.searchsorted(e, x[:, k], "left")
        parts.append(np.eye(len(e) + 1)[low])
    return np.hstack([*parts, x[:, len(MEASURES) :]])


def moments(rows: DataFrame, edges: list[list[float]]) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Mean outer products and numbers of rows, over all rows (u), positives with y 1 (p) and those with y 2 (q).

    rows: x, y. Every task sums its rows; the sums of columns meet in a map-side combined group-by with one group per matrix
    row, so what comes to the driver has the size of two matrices.
    """
    d = 1 + sum(len(e) + 1 for e in edges) + 2 * BUCKETS

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = {kind: np.zeros((d, d)) for kind in "upq"}
        for part in batches:
            c = columns_of(np.array(part["x"]), edges)
            total["u"] += c.T @ c
            for kind, y in (("p", 1), ("q", 2)):
                good = c[[k for k, z in enumerate(part["y"]) if z == y]]
                total[kind] += good.T @ good
        for kind, m in total.items():
            yield {"kind": [kind] * d, "i": list(range(d)), "v": list(m)}

    sums = map_lists(rows.select("x", "y"), run, "kind string, i int, v array<double>")
    sums = sums.groupBy("kind", "i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(d)])
    out = {kind: np.zeros((d, d)) for kind in "upq"}
    for r in sums.collect():
        out[r["kind"]][r["i"]] = r[2:]
    n = {k: m[0, 0] for k, m in out.items()}
    return {k: m / max(1.0, n[k]) for k, m in out.items()}, n


def _parts(m: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """The squared-loss risks of g = columns @ w as positive and as negative, over the rows that have these moments."""
    mean, square = float(m[0] @ w), float(w @ m @ w)
    return (1 - 2 * mean + square) / 4, (1 + 2 * mean + square) / 4


def weighted(u: np.ndarray, p: np.ndarray, prior: float, weight: float, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights of the least prior * Rp+ + weight * (Ru- - prior * Rp-), and that negative part there; weight 1 gives the unbiased risk."""
    w = np.linalg.solve((prior * (1 - weight) * p + weight * u) / 2 + np.eye(len(u)) * ridge, (prior * (1 + weight) * p[0] - weight * u[0]) / 2)
    return w, _parts(u, w)[1] - prior * _parts(p, w)[1]


def class_prior(counts: dict[tuple[int, int], int]) -> float:
    """The ratio of the shares of all rows and of positives above the best cut. counts: rows by (1 for positives or 0 for all, bin of GRID).

    Above any cut, the positives among all rows are the prior times their own share, and there may be others: the ratio is not
    below the prior, and near it where a cut leaves few others. The best cut has the least upper bound (two standard
    errors) of the ratio. The positives must not be those that the outputs were fitted to, which would lie too high.
    """
    above = lambda kind: np.cumsum([counts.get((kind, k), 0) for k in range(len(GRID) + 1)][::-1])[::-1]
    u, p = above(0), above(1)
    if not u[0] or not p[0]:
        return 1.0
    some = p >= max(1, LEAST_ABOVE * p[0])
    ratio = (u[some] / u[0]) / (p[some] / p[0])
    bound = ratio * (1 + 2 * np.sqrt((p[0] - p[some]) / (p[some] * p[0])))
    return float(np.clip(ratio[bound.argmin()], 0.0, 1.0))


def minimise(u: np.ndarray, p: np.ndarray, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the least non-negative risk.

    u, p: mean outer products of the columns, the first of which is constant. Where the unbiased risk is least its negative
    part may be below zero: then the least non-negative risk lies where that part is zero, which is where it counts with
    some weight below one.
    """
    w, part = weighted(u, p, prior, 1.0, ridge)
    low, high = 0.0, 1.0
    while part < 0 and high - low > 1e-6:
        middle = (low + high) / 2
        at, rest = weighted(u, p, prior, middle, ridge)
        if rest >= 0:
            low, w = middle, at
        else:
            high = middle
    return w if part >= 0 or low > 0 else weighted(u, p, prior, 0.0, ridge)[0]


def threshold(counts: dict[tuple[int, int], int], prior: float) -> float:
    """The output above which about the share `prior` of all rows lies: where they are thinnest among the cuts within SLACK of it."""
    n = np.array([counts.get((0, k), 0) for k in range(len(GRID) + 1)])
    if not n.sum():
        return 0.0
    below = np.cumsum(n)[:-1] / n.sum()  # the share of rows under each edge of GRID
    off = np.abs(below - (1 - prior))
    near = np.flatnonzero(off <= max(SLACK, off.min()))
    around = np.convolve(n, np.ones(2 * AROUND), "same")[1:]
    best = near[around[near] == around[near].min()]
    return float(GRID[best[len(best) // 2]])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text), learned from the positives of labels (doc_id, quality)."""
    rows = written(shaped(docs))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.lit(1).alias("y"))
    edges = cuts(rows)
    third = F.pmod(F.xxhash64(F.lit("prior"), "doc_id"), F.lit(3)) == 0
    marked = written(rows.join(good, "doc_id", "left").select("doc_id", "x", F.when(F.col("y") == 1, F.when(third, 2).otherwise(1)).alias("y")))
    mean, n = moments(marked, edges)
    if not n["u"] or not n["p"] + n["q"]:
        return rows.select("doc_id", F.lit(1.0).alias("score"))
    ridge = lambda many: RIDGE + 2 / max(1.0, many)
    positives = (n["p"] * mean["p"] + n["q"] * mean["q"]) / (n["p"] + n["q"])
    first = weighted(mean["u"], mean["p"] if n["p"] else positives, 0.5, 1.0, ridge(n["p"]))[0]
    prior = class_prior(binned(marked, edges, first))
    w = minimise(mean["u"], positives, prior, ridge(n["p"] + n["q"]))
    cut = threshold(binned(marked, edges, w), prior)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for part in batches:
            out = columns_of(np.array(part["x"]), edges) @ w
            yield {"doc_id": part["doc_id"], "score": np.clip((out - cut + 1) / 2, 0, 1)}

    return map_lists(rows, run, "doc_id long, score double")


def binned(marked: DataFrame, edges: list[list[float]], w: np.ndarray) -> dict[tuple[int, int], int]:
    """Counts of outputs by bin of GRID: of all rows (0) and of the positives for the prior (1)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for part in batches:
            found = np.searchsorted(GRID, columns_of(np.array(part["x"]), edges) @ w)
            yield {"y": [1 if y == 2 else 0 for y in part["y"]], "bin": found}

    counts: dict[tuple[int, int], int] = {}
    for r in map_lists(marked.select("x", "y"), run, "y int, bin int").groupBy("y", "bin").count().collect():
        for kind in {0, r["y"]}:
            counts[kind, r["bin"]] = counts.get((kind, r["bin"]), 0) + r["count"]
    return counts


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    held_out: Column = crc_mod(F.col("doc_id"), 3) == 1
    out = scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
