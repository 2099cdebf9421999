"""Connected components against union-find."""

import random

import pytest

from assayer.llm.components import components


def least_reachable(edges):
    up = {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        up.setdefault(a, a)
        up.setdefault(b, b)
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("n, m", [(3, 0), (60, 40), (200, 150)])
def test_random_edges_with_nulls_loops_and_repeats(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += edges[:5] + [(None, 1), (2, None), (1, 1)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == least_reachable(edges)


def test_a_long_path_takes_few_rounds(spark):
    edges = [(k, k + 1) for k in range(60)]
    got = components(spark.createDataFrame(edges, "a long, b long"), max_rounds=12).collect()
    assert {r.node: r.component for r in got} == dict.fromkeys(range(61), 0)
