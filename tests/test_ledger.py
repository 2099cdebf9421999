"""Streams into ledgered tables: batches that come again, batches that broke off, and one fold over everything."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.streaming import ledger

SCHEMA = "case_id string, event_id long, status string, at timestamp, other string"
T0 = datetime.datetime(2024, 1, 1)


def _events(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        case = rng.choice(("hot", "hot", *map(str, range(25)), None))
        status = rng.choice((*ledger.STATUSES, "queued", "fetching", "unheard", None))
        rows.append((case, k, status, T0 + datetime.timedelta(minutes=k // 3), "x"))
    return rows


def _plain(rows):
    state, illegal = {}, []
    for case, event, status, at, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        was, at_was, event_was, n = state.get(case, ("", None, None, 0))
        if event_was is not None and (at, event) <= (at_was, event_was):
            illegal.append((case or "", event, "late"))
        elif (was, status) not in ledger.LEGAL:
            illegal.append((case or "", event, "transition" if status in ledger.STATUSES else "unknown"))
        else:
            state[case] = (status, at, event, n + 1)
    return {(c or "", s, e, n) for c, (s, _, e, n) in state.items()}, sorted(illegal)


def _state(df):
    return {(r["case_id"] or "", r["status"], r["event_id"], r["changes"]) for r in df.collect()}


def _illegal(df):
    return sorted((r["case_id"] or "", r["event_id"], r["reason"]) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/table"


def test_one_fold_equals_the_plain_version(spark):
    rows = _events()
    out = ledger.advanced(spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(3))
    state, illegal = _plain(rows + rows[:5])
    assert _state(out.where("kind = 'state'")) == state and _illegal(out.where("kind = 'illegal'")) == illegal


def test_batches_equal_one_fold_and_replays_change_nothing(spark, folder):
    rows = _events(2)
    table = ledger.StatusTable(spark, folder)
    batches = [spark.createDataFrame(rows[k : k + 100], SCHEMA) for k in range(0, 400, 100)]
    for number, batch in enumerate(batches):
        table(batch, number)
        table(batch, number)
    for number in (3, 0, 2):
        table(batches[number], number)
    state, illegal = _plain(rows)
    assert _state(table.state()) == state and _illegal(table.illegal()) == illegal
    table(batches[1], 9)  # the same events under another number are late
    assert _state(table.state()) == state and {r["reason"] for r in table.illegal().where("batch = 9").collect()} <= {"late", "transition", "unknown"}


def test_a_batch_that_broke_off_counts_for_nothing(spark, folder, monkeypatch):
    rows = _events(3, 200)
    table = ledger.StatusTable(spark, folder)
    table(spark.createDataFrame(rows[:100], SCHEMA), 0)
    before = _state(table.state())

    def lost(self, batch, versions):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "enter", lost)
        with pytest.raises(OSError):
            table(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert _state(table.state()) == before and not table.illegal().where("batch = 1").count()
    table(spark.createDataFrame(rows[100:], SCHEMA), 1)
    assert _state(table.state()) == _plain(rows)[0]


def test_a_batch_rewrites_its_buckets_only(spark, folder):
    table = ledger.StatusTable(spark, folder)
    table(spark.createDataFrame([(str(k), k, "queued", T0, "x") for k in range(200)], SCHEMA), 0)
    table(spark.createDataFrame([("7", 900, "fetching", T0 + datetime.timedelta(1), "x")], SCHEMA), 1)
    assert sorted(table.ledger.versions().values()).count(1) == 1
    assert table.state().count() == 200 and table.state().where("status = 'fetching'").count() == 1
    table(spark.createDataFrame([], SCHEMA), 2)
    assert table.state().count() == 200


def test_a_stream_into_the_table(spark, folder, tmp_path):
    rows = _events(4, 300)
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    table = ledger.StatusTable(spark, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream.writeStream.foreachBatch(table).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert _state(table.state()) == _plain(rows)[0]


def test_session_logs(spark, folder):
    log = ledger.SessionLog(spark, folder)
    line = lambda s, k, kind, text, role="user": (s, "c1" if k else None, "US", "m", k, role, text, f"2024-01-01T00:0{k}", kind)
    first = spark.createDataFrame([line("a", 0, "said", "hello"), line("b", 0, "said", "hi")], ledger.LINE)
    second = spark.createDataFrame([line("a", 2, "recommendation", "wait"), line("a", 1, "said", "yes", "assistant"), line("a", 3, "end", None)], ledger.LINE)
    assert log.documents().collect() == []
    for batch, number in ((first, 0), (first, 0), (second, 1), (first, 0)):
        log(batch, number)
    docs = {r["session_id"]: json.loads(r["document"]) for r in log.documents().collect()}
    assert set(docs) == {"a", "b"} and [t["content"] for t in docs["a"]["conversation"]] == ["hello", "yes"]
    assert docs["a"]["final_recommendation"] == "wait" and docs["a"]["ended_at"].endswith("3") and docs["a"]["case_id"] == "c1" and "ended_at" not in docs["b"]
    log(spark.createDataFrame([line("b", 0, "said", "hi again")], ledger.LINE), 2)
    assert log.lines().where(F.col("session_id") == "b").collect()[0]["content"] == "hi again"
