"""Folds over passing rows against plain versions that hold whole documents."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import documents, folds


def _run(fold, rows):
    out = []
    for r in rows:
        out += fold.add(*r)
    return out + [*fold.end()]


@pytest.mark.parametrize("seed", range(40))
def test_packing_equals_the_plain_version(seed):
    rng = random.Random(seed)
    items = [(k, rng.choice((0, 0, 1, 2, 3, 5, 9, 14, 40))) for k in range(rng.randint(0, 60))]
    budget, overlap = rng.choice(((10, 5), (10, 0), (12, 12), (30, 4), (1, 1), (20, 50)))
    assert _run(folds.Packing(budget, overlap), [(0, *x) for x in items]) == documents.packed(items, budget, overlap)


def test_packing_holds_little():
    fold = folds.Packing(100, 20)
    for k in range(20_000):
        list(fold.add(0, k, k % 3))
        assert len(fold.tail) <= 21


def _selected(rows, rooms, last, first):
    taken = {}
    orders = [("last", range(len(rows) - 1, max(-1, len(rows) - 1 - last), -1)), ("term", [k for k, r in enumerate(rows) if r[2]]), ("first", range(min(first, len(rows)))), ("middle", range(len(rows)))]
    for (reason, order), room in zip(orders, rooms, strict=True):
        for k in order:
            if k not in taken and rows[k][1] <= room:
                taken[k] = reason
                room -= rows[k][1]
    return sorted((rows[k][0], r) for k, r in taken.items())


@pytest.mark.parametrize("seed", range(40))
def test_selection_equals_the_plain_version(seed):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 9), rng.random() < 0.3) for k in range(rng.choice((0, 1, 4, 7, 12, 50)))]
    rooms = tuple(rng.randint(0, 40) for _ in range(4))
    assert sorted(_run(folds.Selection(rooms, 5, 4), rows)) == _selected(rows, rooms, 5, 4)


def test_documents_over_tasks(spark):
    rng = random.Random(3)
    rows = [(d, k, rng.choice((None, 3, 8, 30)), rng.choice(("a Breach of it", None, "plain")), rng.choice((True, False, None)), "x") for d in [None, 1, 2, 3] for k in range(rng.randint(1, 80))]
    rows += [(9, k, 5, "plain", False, "x") for k in range(3000)]  # most rows are one document's
    df = spark.createDataFrame(rows, "d long, pos int, tok int, text string, pri boolean, key string").drop("key").repartition(5)
    got = sorted((r["d"] or 0, *tuple(r)[1:]) for r in documents.segments(df, "d", "pos", "tok", 40, 10, "pri").collect())
    want = []
    for d in (None, 1, 2, 3, 9):
        number = 0
        for flag in (True, False):
            for s in documents.packed([(r[1], r[2] or 0) for r in rows if r[0] == d and bool(r[4]) == flag], 40, 10):
                want.append((d or 0, number, *s[1:]))
                number += 1
    assert got == sorted(want)
    got = sorted((r["d"] or 0, r["pos"], r["reason"]) for r in documents.evidence_context(df, "d", "pos", "text", "tok", ["BREACH"], 200).collect())
    want = [(d or 0, *x) for d in (None, 1, 2, 3, 9) for x in _selected([(r[1], r[2] or 0, "breach" in (r[3] or "").lower()) for r in rows if r[0] == d], (60, 50, 50, 30), 20, 15)]
    assert got == sorted(want)
    plan = documents.segments(df, "d", "pos", "tok")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "text" not in plan.split("== Physical Plan ==")[1].split("Exchange")[0]
    assert documents.segments(df.where(F.lit(False)), "d", "pos", "tok").collect() == []
