"""The expiring cache over several runs against a dictionary."""

import datetime
import random

import pytest

from assayer.sources.cache import ExpiringCache

T0 = datetime.datetime(2024, 3, 1, 12)
SCHEMA = "url string, fetched_at timestamp, status int, body string"


@pytest.fixture
def cache(spark, tmp_path):
    return ExpiringCache(spark, f"file://{tmp_path}/cache", SCHEMA, "url", days=30)


def _days(cache):
    return sorted(cache._partitions())


def _got(cache, now):
    return sorted((r["url"], r["fetched_at"], r["body"]) for r in cache.get(now).collect())


def _put(cache, rows, now):
    cache.put(cache.spark.createDataFrame(rows, SCHEMA), now)


def test_three_runs(cache):
    day = datetime.timedelta(days=1)
    assert _got(cache, T0) == []
    _put(cache, [("a", T0, 200, "one"), ("b", T0, 200, "two"), ("c", T0, 200, None), (None, T0, 200, "nobody"), ("d", None, 200, "never")], T0)
    assert _got(cache, T0) == [("a", T0, "one"), ("b", T0, "two"), ("c", T0, None)] and _days(cache) == ["2024-03-01"]
    later = T0 + 3 * day
    _put(cache, [("a", later, 200, "newer"), ("a", later - day, 200, "between"), ("b", T0 - 2 * day, 200, "older"), ("b", T0, 200, "two")], later)
    assert _got(cache, later) == [("a", later, "newer"), ("b", T0, "two"), ("c", T0, None)] and _days(cache) == ["2024-03-01", "2024-03-04"]
    last = T0 + 31 * day
    assert _got(cache, last) == [("a", later, "newer")]  # two have expired, though they still lie there
    _put(cache, [("e", last, 200, "late")], last)
    assert _got(cache, last) == [("a", later, "newer"), ("e", last, "late")] and _days(cache) == ["2024-03-04", "2024-04-01"]


def test_a_day_that_all_rows_have_left_goes(cache):
    _put(cache, [("a", T0, 200, "x"), ("b", T0, 200, "x")], T0)
    _put(cache, [(k, T0 + datetime.timedelta(days=2), 200, "y") for k in "ab"], T0)
    assert _days(cache) == ["2024-03-03"]


def test_untouched_days_are_not_rewritten(cache):
    _put(cache, [("a", T0, 200, "x")], T0)
    files = {str(f) for f in cache.spark.read.parquet(f"{cache.folder}/day=2024-03-01").inputFiles()}
    _put(cache, [("b", T0 + datetime.timedelta(days=1), 200, "y")], T0)
    assert {str(f) for f in cache.spark.read.parquet(f"{cache.folder}/day=2024-03-01").inputFiles()} == files


def test_a_put_that_broke_off_before_removing_does_no_harm(cache, monkeypatch):
    _put(cache, [("a", T0, 200, "x")], T0)
    later = T0 + datetime.timedelta(days=2)
    with monkeypatch.context() as m:
        calls = []
        real = ExpiringCache._partitions
        m.setattr(ExpiringCache, "_partitions", lambda self: calls.append(1) or (real(self) if len(calls) == 1 else {}))
        _put(cache, [("a", later, 200, "y")], later)
    assert len(_days(cache)) == 2 and _got(cache, later) == [("a", later, "y")]
    _put(cache, [("a", later, 200, "y")], later)
    assert _days(cache) == ["2024-03-03"]


def test_random_runs_equal_a_dictionary(cache):
    rng = random.Random(5)
    held, now = {}, T0
    for _ in range(4):
        now += datetime.timedelta(days=rng.randint(1, 14))
        rows = [(f"u{rng.randint(0, 30)}", now - datetime.timedelta(hours=rng.randint(0, 900)), 200, f"b{k}") for k in range(25)]
        _put(cache, rows, now)
        for url, at, _, body in rows:
            held[url] = max(held.get(url, (at, body)), (at, body))
        held = {u: x for u, x in held.items() if x[0] > now - datetime.timedelta(days=30)}
        assert _got(cache, now) == sorted((u, *x) for u, x in held.items())
