import datetime
import json

import pytest
from pyspark.sql import functions as F

from assayer.sources import readers, search, sinks


def _log(session, case="bailii-x", **more):
    return {"session_id": session, "case_id": case, "llm_name": "m", "started_at": "2024-01-02T03:04:05Z", **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("logs")
    chat = [{"role": "user", "content": "a?"}, {"role": "assistant", "content": "b"}, {"role": "user", "content": "[FINAL RECOMMENDATION] c"}]
    checks = [{"criterion": "x", "met": True}, {"criterion": "y", "met": False}, {"criterion": "z", "met": None}]
    files = {
        "a": _log("s1", conversation=chat, evaluation={"score": 2, "checklist": checks}, evaluation_claude={"score": 0}, evaluation_grok={"score": 1}, evaluation_gpt5={"score": 2}),
        "b": _log("s2", "courtliste-1", started_at="never"),
        "c": _log("s3", "nzlii-2", evaluation={"score": 3}),
        "d": {"session_id": "s4"},
        "e": _log("s5", "gone-1", conversation=[{"role": "user", "content": "[FINAL RECOMMENDATION]"}]),
    }
    for name, body in files.items():
        (d / f"{name}.json").write_text(json.dumps(body, indent=1))
    (d / "f.json").write_text("{not json")
    return str(d)


def test_logs_and_rejected_files(spark, folder):
    good, bad = readers.logs(spark, folder)
    assert {r["session_id"] for r in good.collect()} == {"s1", "s2", "s5"}
    assert sorted((r["_file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()) == [("c.json", "score_out_of_range"), ("d.json", "missing_id"), ("f.json", "unreadable")]


def test_run_records(spark, folder):
    good, _ = readers.logs(spark, folder)
    runs, skipped = readers.run_records(good, spark.createDataFrame([("gone-1",)], "case_id string"))
    rows = {r["run_id"]: r for r in runs.collect()}
    assert set(rows) == {"s1", "s2"} and [r["run_id"] for r in skipped.collect()] == ["s5"]
    one, two = rows["s1"], rows["s2"]
    assert (one["score_0_2"], one["liability_code"], one["questions_asked"], one["met_criteria_count"], one["missing_criteria_count"]) == (2, 0, 1, 1, 2)
    assert (one["majority"], one["three_way_tie"], one["mean_score"]) == (0, True, 1.0)
    assert one["started_at"] == datetime.datetime(2024, 1, 2, 3, 4, 5) and two["started_at"] is None
    assert two["eval_missing"] and two["score_0_2"] == 1 and two["jurisdiction"] == "US" and two["majority"] is None
    assert readers.criteria(runs).count() == 3
    assert [r["case_id"] for r in readers.completed(good, "m").orderBy("case_id").collect()] == ["bailii-x", "courtliste-1", "gone-1"]


def test_cases_of_both_shapes(spark, tmp_path):
    (tmp_path / "k-1.json").write_text(json.dumps({"source_url": "u", "simulation": {"testable": False, "initial_state": {"medications": ["a", "b"]}}}))
    (tmp_path / "k-2.json").write_text(json.dumps({"case_id": "k2", "url": "v", "simulation": {"testable": True, "initial_state": {"medications": "none"}}}))
    rows = readers.cases(spark, str(tmp_path))
    got = {r["case_id"]: (r["url"], r["simulation"]["initial_state"]["medications"].replace(" ", "")) for r in rows.collect()}
    assert got == {"k-1": ("u", '["a","b"]'), "k2": ("v", "none")}
    assert [r["case_id"] for r in readers.untestable_ids(rows).collect()] == ["k-1"]


def test_prices_and_optional(spark, tmp_path):
    (tmp_path / "p.csv").write_text("primary_code,description,plan_name,negotiated_dollar,min_charge,max_charge\n0012,x,A,1.5,,2\n,y,A,1,1,1\n7,z,B,oops,1,1\n")
    rows = {r["primary_code"]: r for r in readers.prices(spark, str(tmp_path / "p.csv")).collect()}
    assert set(rows) == {"0012", "7"} and rows["0012"]["min_charge"] is None and rows["7"]["negotiated_dollar"] is None
    assert readers.optional(spark, str(tmp_path / "none.csv"), "a string").count() == 0


def test_sinks_round_trip(spark, tmp_path, folder):
    good, _ = readers.logs(spark, folder)
    runs, _ = readers.run_records(good, spark.createDataFrame([], "case_id string"))
    sinks.export(runs, readers.criteria(runs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet/runs")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv/criteria")).count() == 3
    costs = spark.createDataFrame([("r", ["a", "b"])], "run_id string, unmatched_procedures array<string>")
    sinks.cost_summary(costs, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["unmatched_procedures"] == "a|b"
    with pytest.raises(ValueError):
        sinks.cost_summary(costs, str(tmp_path / "d"), "xml")
    asked = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "k string, p string")
    mapping = sinks.requests(asked, str(tmp_path / "q"), "k", "p", "m")
    assert spark.read.json(str(tmp_path / "q/requests")).join(mapping, "custom_id").count() == 2
    sinks.quarantined(asked.withColumn("why", F.when(F.col("k") == "k1", "bad")), "why", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/kept")).count() == spark.read.parquet(str(tmp_path / "s/quarantined")).count() == 1
    new = sinks.with_evaluation(asked, spark.createDataFrame([("k1", 2)], "k string, score int"), "k", "score")
    assert {r["k"]: r["score"] for r in new.collect()} == {"k1": 2, "k2": None}
    assert sinks.markdown(asked).count("\n") == 3


def test_search_source(spark, tmp_path):
    (tmp_path / "a_b-2021.jsonl").write_text(json.dumps({"title": "t", "url": "u", "date": "2021-01-01"}) + "\n")
    search.register(spark)
    rows = spark.read.format("case_search").option("queries", "a b|c").option("first", "2020").option("last", "2021").option("folder", str(tmp_path)).load()
    assert [(r["query"], r["year"], r["title"]) for r in rows.collect()] == [("a b", 2021, "t")] and rows.rdd.getNumPartitions() == 4
