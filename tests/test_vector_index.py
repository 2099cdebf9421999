"""The stored vector index against a plain product of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import vector_index

SCHEMA = "code string, v array<double>, list int, cell string"


def _rows(seed, n=400, dims=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(7, dims))
    vectors = centers[rng.integers(0, 7, n)] + 0.3 * rng.normal(size=(n, dims))
    rows = [(f"c{k:04d}", [*map(float, v)], 1, "x") for k, v in enumerate(vectors)]
    hot = [(f"h{k:04d}", rows[3][1], 1, "x") for k in range(n // 2)]  # a third of all rows are the same vector
    return rows + hot + rows[:5] + [("none", None, 1, "x"), ("zero", [0.0] * dims, 1, "x"), (None, rows[9][1], 1, "x")]


def _plain(index, queries, k, threshold, same=False):
    held = sorted(((c, np.array(v)) for c, v, *_ in index if v and any(v)), key=lambda r: (r[0] is not None, r[0] or ""))
    matrix = np.array([v / np.linalg.norm(v) for _, v in held])
    out = []
    for q, v in queries:
        if not v or not any(v):
            continue
        scores = np.round(matrix @ (np.array(v) / np.linalg.norm(v)), 12)
        ranked = [j for j in np.argsort(-scores, kind="stable") if scores[j] >= threshold and not (same and held[j][0] == q and q is not None)][:k]
        out += [(q or "", held[j][0] or "", round(float(scores[j]), 9), r + 1) for r, j in enumerate(ranked)]
    return sorted(out)


def _got(found, query):
    return sorted((r[query] or "", r["code"] or "", round(r["score"], 9), r["rank"]) for r in found.collect())


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/index"


@pytest.mark.parametrize("k, threshold, same", [(5, 0.3, False), (1, 0.9, True), (3, -1.0, True)])
def test_matches_equal_the_plain_product(spark, folder, monkeypatch, k, threshold, same):
    monkeypatch.setattr(vector_index, "LIST_ROWS", 60)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 50)
    rows = _rows(1)
    index = vector_index.built(spark.createDataFrame(rows, SCHEMA), "code", "v", folder, cells=9)
    lists = index.lists().groupBy("cell", "list").count().agg(F.max("count"), F.count("*")).first()
    assert lists[0] < 120 and lists[1] > 10
    found = vector_index.search(index, spark.createDataFrame(rows, SCHEMA), "code", "v", k, threshold, same) if same else None
    if same:  # the query's id column and the index's have the same name
        pairs = found.toDF("q", "code", "score", "rank")
        assert _got(pairs, "q") == _plain(rows, [r[:2] for r in rows], k, threshold, True)
    else:
        asked = [(f"q{j}", v) for j, v in enumerate(np.random.default_rng(2).normal(size=(120, 6)).tolist())] + [("q0", [1.0] * 6), ("none", None), ("zero", [0.0] * 6), ("long", [1.0] * 7)]
        found = vector_index.search(index, spark.createDataFrame(asked, "q string, vec array<double>"), "q", "vec", k, threshold)
        assert _got(found, "q") == _plain(rows, asked[:-1], k, threshold)


def test_cells_that_cannot_match_are_not_visited(spark, folder, monkeypatch):
    rows = [(f"{a}{k}", [float(a == b) + 0.01 * ((k * (b + 1)) % 7) for b in range(6)]) for a in range(6) for k in range(40)]
    index = vector_index.built(spark.createDataFrame(rows, "code string, v array<double>"), "code", "v", folder, cells=6)
    visited = []
    meeting = vector_index._meeting
    monkeypatch.setattr(vector_index, "_meeting", lambda ix, visits, *rest: visited.append(visits.count()) or meeting(ix, visits, *rest))
    found = vector_index.search(index, spark.createDataFrame(rows, "q string, v array<double>"), "q", "v", 2, 0.5)
    assert _got(found, "q") == _plain(rows, rows, 2, 0.5)
    assert visited == [240, 0]


def test_a_second_run_reads_and_a_changed_source_builds(spark, folder, monkeypatch):
    rows = _rows(3, 60)
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    fits = []
    fit = vector_index.KMeans.fit
    monkeypatch.setattr(vector_index.KMeans, "fit", lambda self, df: fits.append(1) or fit(self, df))
    first = vector_index.built(frame(rows), "code", "v", folder)
    assert vector_index.built(frame(rows[::-1]), "code", "v", folder).path == first.path and len(fits) == 1  # in any order
    changed = [("c0000", [9.0, *rows[0][1][1:]], 1, "x"), *rows[1:]]
    second = vector_index.built(frame(changed), "code", "v", folder)
    assert second.path != first.path and len(fits) == 2
    assert vector_index.built(frame(rows), "code", "v", folder).path == first.path and len(fits) == 2  # the first is still there
    assert vector_index.built(frame(rows), "code", "v", folder, force=True).path == first.path and len(fits) == 3
    assert first.manifest["n"] == 60 + 30 + 5 + 1
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{first.path}/manifest")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    vector_index.built(frame(rows), "code", "v", folder)  # a build that did not come to its end is no version
    assert len(fits) == 4


def test_awkward_indexes(spark, folder):
    empty = vector_index.built(spark.createDataFrame([], SCHEMA), "code", "v", folder)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "q string, v array<double>")
    assert vector_index.search(empty, asked, "q", "v").collect() == []
    one = vector_index.built(spark.createDataFrame([("a", [2.0, 0.0], 1, "x")], SCHEMA), "code", "v", folder)
    assert _got(vector_index.search(one, asked, "q", "v"), "q") == [("q", "a", 1.0, 1)]
    with pytest.raises(ValueError, match="dimensions"):
        vector_index.built(spark.createDataFrame([("a", [2.0], 1, "x"), ("b", [2.0, 1.0], 1, "x")], SCHEMA), "code", "v", folder)


def test_visits_of_the_second_pass_are_not_broadcast(spark, folder, monkeypatch):
    rows = [(r[0], r[1]) for r in _rows(5) if r[0]]
    index = vector_index.built(spark.createDataFrame(rows, "code string, v array<double>"), "code", "v", folder, cells=9)
    plans = []
    meeting = vector_index._meeting
    monkeypatch.setattr(vector_index, "_meeting", lambda ix, visits, *rest: plans.append(visits._jdf.queryExecution().executedPlan().toString()) or meeting(ix, visits, *rest))
    found = vector_index.search(index, spark.createDataFrame(rows, "q string, v array<double>"), "q", "v", 2, 0.5)
    assert _got(found, "q") == _plain(rows, rows, 2, 0.5)
    assert "SortMergeJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]


@pytest.mark.parametrize("k, threshold, same", [(2, 0.1, False), (3, -1.0, True)])
def test_queries_meet_few_vectors_where_they_stand(spark, folder, k, threshold, same):
    few = _rows(5, n=14)
    index = vector_index.built(spark.createDataFrame(few, SCHEMA), "code", "v", folder)
    asked = [(f"c{j:04d}", v) for j, v in enumerate(np.random.default_rng(6).normal(size=(300, 6)).tolist())] + [(None, few[2][1]), ("none", None), ("zero", [0.0] * 6)]
    odd = [("long", [1.0] * 7), ("nan", [float("nan")] + [1.0] * 5), ("hole", [None] + [1.0] * 5), ("far", [float("inf")] + [1.0] * 5)]
    found = vector_index.search(index, spark.createDataFrame(asked + odd, "q string, vec array<double>"), "q", "vec", k, threshold, same)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert _got(found, "q") == _plain(few, asked, k, threshold, same)
