"""The frontier search against a walk one citation after the other."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import frontier


def _walk(seeds, edges, known, depth, most):
    """Finds (node, depth, cited_by) in order, and first citations of known nodes."""
    discovered, found, links = set(), [], []
    there = set(known) | {s for s, _ in seeds}
    level = [s for s, _ in sorted({s: r for s, r in sorted(seeds, key=lambda x: -x[1])}.items(), key=lambda x: x[1])]
    for d in range(1, depth + 1):
        following = []
        for node in level:
            for _, dst, ok in sorted((p, t, k) for s, p, t, k in edges if s == node and t is not None):
                if len(found) >= most:
                    return found, links
                if dst in discovered:
                    continue
                discovered.add(dst)
                if not ok:
                    continue
                if dst in there:
                    links.append((dst, node, d))
                    continue
                found.append((dst, d, node))
                following.append(dst)
        level = following
    return found, links


def _got(spark, seeds, edges, known, depth, most):
    s = spark.createDataFrame(seeds, "node long, seed_rank long")
    e = spark.createDataFrame([(a, p, b, "of interest" if ok else None) for a, p, b, ok in edges], "src long, place long, dst long, text string").repartition(3)
    k = spark.createDataFrame([(n,) for n in known], "node long")
    out = frontier.explored(s, e, F.contains("text", F.lit("interest")), k, depth, most)
    rows = out.nodes.orderBy("found_as").collect()
    assert [r["found_as"] for r in rows] == list(range(len(rows)))
    return [(r["node"], r["depth"], r["cited_by"]) for r in rows], {tuple(r) for r in out.known.collect()}, {r["depth"]: r["priority"] for r in rows}


@pytest.mark.parametrize("seed, most", [(1, 1000), (2, 12), (3, 3)])
def test_random_graphs_with_cycles_and_diamonds(spark, seed, most):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 40), k, rng.choice((rng.randint(0, 40), None, 1, 2)), rng.random() < 0.7) for k in range(150)]
    edges += [(5, 200, 6, True), (6, 201, 5, True), (7, 202, 7, True), (0, 203, 50, True), (0, 204, 51, True), (50, 205, 52, True), (51, 206, 52, True)]
    seeds, known = [(0, 3), (9, 1), (0, 7)], [2, 11, 12]
    want, links = _walk(seeds, edges, known, 3, most)
    got, told, priorities = _got(spark, seeds, edges, known, 3, most)
    assert got == want
    assert set(links) <= told  # beyond the cap the same level's citations are told as well
    if most > 100:
        assert told == set(links) and priorities == {d: round(0.9 - 0.1 * d, 6) for _, d, _ in want}


def test_a_first_citation_out_of_context_is_final(spark):
    edges = [(1, 0, 2, False), (1, 1, 3, True), (3, 0, 2, True), (3, 1, 4, True)]
    assert _got(spark, [(1, 0)], edges, [], 2, 10)[0] == [(3, 1, 1), (4, 2, 3)] == _walk([(1, 0)], edges, [], 2, 10)[0]


def test_ends(spark):
    assert _got(spark, [], [(1, 0, 2, True)], [], 2, 10)[0] == []
    assert _got(spark, [(1, 0)], [], [], 2, 10)[0] == []
    assert _got(spark, [(1, 0)], [(1, 0, 2, True)], [], 2, 0)[0] == []
