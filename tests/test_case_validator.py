"""Case documents that are right, and changed in one place each."""

import copy
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators import case_schema, case_validator


def _case():
    point = lambda k, a, e, **more: {
        "decision_id": f"P{k}", "phase_id": "later", "prompt": "Which?", "action_type": "CHOOSE", "options": [{"option_id": "x", "description": "wait"}, {"option_id": "y", "description": "act"}],
        "actual_action_defendant": {"description": "waited", "evidence_ids": [a]}, "expected_action_court": {"description": "act at once", "evidence_ids": [e]}, "scoring_rubric": {"max_score": 4}, **more,
    }
    return {
        "schema_version": "1", "case_id": "c-7", "source": "S", "jurisdiction": "J", "court": "High", "decision_date": "2001-02-03", "url": "https://x.org/7", "clinical_domain": "D",
        "outcome_severity": "MILD", "summary": {"brief": "In short."}, "evidence_index": [{"evidence_id": "e1", "text": "seen"}, {"evidence_id": "e2", "text": "heard"}],
        "simulation": {
            "initial_state": {"chief_complaint": "pain", "evidence_ids": ["e1"]}, "requestables": [{"request_id": "r1", "evidence_ids": ["e2"]}],
            "decision_points": [point(1, "e1", "e2", is_malpractice_point=True), point(2, "e1", "e2")],
            "end_state": {"patient_outcome": {"description": "well", "evidence_ids": ["e1"]}, "legal_outcome": {"verdict": "NONE", "evidence_ids": ["e2"]}},
        },
        "ground_truth": {"factual_timeline": [{"event": "came", "evidence_ids": ["e1"]}, {"event": "left", "evidence_ids": ["e1"]}]},
        "taxonomy_labels": {"malpractice_categories": ["DELAY"]}, "quality": {"validation_passed": True},
    }


def _put(path, value):
    def change(case):
        *way, last = path
        for k in way:
            case = case[k]
        if value is None:
            del case[last]
        else:
            case[last] = value

    return change


P0, P1 = ("simulation", "decision_points", 0), ("simulation", "decision_points", 1)
CHANGES = [
    ("nothing", lambda c: None, []),
    ("complaint", _put(("simulation", "initial_state", "chief_complaint"), ""), ["MISSING_REQUIRED"]),
    ("no citation at the start", _put(("simulation", "initial_state", "evidence_ids"), []), ["NO_EVIDENCE"]),
    ("lost reference", _put((*P0, "actual_action_defendant", "evidence_ids"), ["e1", "e9"]), ["ORPHAN_EVIDENCE_REF"]),
    ("one point", lambda c: c["simulation"]["decision_points"].pop(), ["INSUFFICIENT_DECISION_POINTS"]),
    ("same point", _put((*P1, "decision_id"), "P1"), ["DUPLICATE_ID"]),
    ("points without ids", lambda c: [p.pop("decision_id") for p in c["simulation"]["decision_points"]], ["DUPLICATE_ID"]),
    ("one option", _put((*P1, "options"), [{"option_id": "x"}]), ["INSUFFICIENT_OPTIONS"]),
    ("no actual action", _put((*P0, "actual_action_defendant"), None), ["MISSING_ACTUAL_ACTION", "NO_EVIDENCE"]),
    ("no expected action", _put((*P0, "expected_action_court", "description"), ""), ["MISSING_EXPECTED_ACTION"]),
    ("nobody at fault", _put((*P0, "is_malpractice_point"), False), ["NO_MALPRACTICE_POINT"]),
    ("no timeline", _put(("ground_truth", "factual_timeline"), []), ["EMPTY_TIMELINE"]),
    ("event without evidence", _put(("ground_truth", "factual_timeline", 1, "evidence_ids"), None), ["NO_EVIDENCE"]),
    ("same request", lambda c: c["simulation"]["requestables"].append({"request_id": "r1"}), ["DUPLICATE_ID"]),
    ("no court", _put(("court",), None), ["MISSING_REQUIRED"]),
    ("no summary", _put(("summary",), {}), ["MISSING_REQUIRED", "INCOMPLETE_SUMMARY"]),
    ("no brief", _put(("summary", "brief"), ""), ["INCOMPLETE_SUMMARY"]),
    ("no label", _put(("taxonomy_labels", "malpractice_categories"), []), ["MISSING_TAXONOMY"]),
    ("no outcome", _put(("simulation", "end_state", "legal_outcome"), None), ["MISSING_REQUIRED"]),
    ("unused evidence", lambda c: c["evidence_index"].extend({"evidence_id": f"u{k}"} for k in range(3)), ["LOW_EVIDENCE_COVERAGE"]),
    ("number for text", _put(("court",), 7), ["SCHEMA_ERROR"]),
    ("object for list", _put(("simulation", "requestables"), {"request_id": "r1"}), ["SCHEMA_ERROR"]),
    ("unknown key", _put((*P0, "colour"), {"a": [1]}), ["SCHEMA_ERROR"]),
    ("twenty lost", _put((*P0, "actual_action_defendant", "evidence_ids"), ["e1", *(f"x{k}" for k in range(20))]), ["ORPHAN_EVIDENCE_REF"] * 10),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = []
    for name, change, _ in CHANGES:
        case = copy.deepcopy(_case())
        change(case)
        rows.append((name, json.dumps(case)))
    rows += [("no json", "{oops"), ("null", None), ("list", "[1]"), ("empty", "{}")]
    cases = spark.createDataFrame(rows, "name string, doc string")
    return {r["name"]: r for r in case_validator.validated(cases, "doc").collect()}


@pytest.mark.parametrize("name, codes", [(n, c) for n, _, c in CHANGES])
def test_each_change_has_its_codes(results, name, codes):
    row = results[name]
    assert Counter(i["code"] for i in row["issues"]) == Counter(codes)
    assert row["valid"] == (not any(i["severity"] == "error" for i in row["issues"]))


def test_all_fifteen_codes_are_met(results):
    assert len({c for _, _, codes in CHANGES for c in codes} | {i["code"] for i in results["no json"]["issues"]}) == 15


def test_fields_scores_and_stats(results):
    right = results["nothing"]
    assert right["scores"].asDict() == pytest.approx({"evidence_coverage": 1.0, "simulation_completeness": 0.8, "decision_point_quality": 1.0, "overall": 0.92})
    assert right["stats"]["decision_point_count"] == 2 and right["stats"]["missing_top_level"] == []
    assert results["lost reference"]["issues"][0]["field"] == ".simulation.decision_points[0].actual_action_defendant.evidence_ids"
    assert results["same point"]["issues"][0]["field"] == "simulation.decision_points[1].decision_id"
    assert results["unused evidence"]["issues"][0]["message"] == "Only 40% of evidence items are referenced"
    assert results["unknown key"]["issues"][0].asDict() == {"severity": "warning", "code": "SCHEMA_ERROR", "field": "simulation.decision_points[0].colour", "message": "not in the schema"}
    assert results["number for text"]["issues"][0]["message"] == "expected string, found BIGINT"
    assert not results["same point"]["valid"] and results["same point"]["valid_lenient"] and not results["no court"]["valid_lenient"]
    assert results["one option"]["scores"]["decision_point_quality"] == pytest.approx(0.8)


def test_documents_that_cannot_be_read(results):
    assert [i["code"] for i in results["no json"]["issues"]][0] == "SCHEMA_VALIDATION_FAILED"
    assert [i["message"] for i in results["list"]["issues"]][0] == "expected an object, found ARRAY"
    rest = lambda n: [tuple(i) for i in results[n]["issues"] if not i["code"].startswith("SCHEMA")]
    assert rest("no json") == rest("null") == rest("list") == rest("empty") and len(rest("null")) == 22
    assert results["null"]["scores"]["overall"] == 0.0


def test_required_paths_and_places(spark):
    wanted = StructType.fromDDL("id BIGINT, lines ARRAY<STRUCT<price: DOUBLE, flags: ARRAY<BOOLEAN>>>")
    docs = ['{"id":1,"lines":[{"price":2,"flags":[true]},{"price":"2"},{"flags":[1,null]}]}', '{"lines":{"price":1}}', '{"id":1.5,"lines":[]}', '{"id":null}']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string")
    got = {r["k"]: [(i["field"], i["message"]) for i in r["x"]] for r in df.select("k", case_schema.schema_issues(F.col("doc"), wanted, ("id", "lines[].price")).alias("x")).collect()}
    missing = "a required value is missing"
    assert got == {
        0: [("lines[1].price", "expected a number, found STRING"), ("lines[2].price", missing), ("lines[2].flags[0]", "expected boolean, found BIGINT")],
        1: [("id", missing), ("lines", "expected an array, found OBJECT")], 2: [("id", "expected bigint, found DECIMAL")], 3: [("id", missing)],
    }


def test_parts_whose_types_fit_are_not_taken_apart(spark):
    """A worked-out value is no element of an array, whose type would be asked for row by row, and merged types of elements hide nothing."""
    wanted = StructType.fromDDL("a STRUCT<b: ARRAY<STRUCT<c: STRING, d: ARRAY<DOUBLE>>>>, e BIGINT")
    docs = [
        '{"a":{"b":[{"c":"x","d":[1,2.5]},null,{"c":"y"}]},"e":1}', '{"a":{"b":[{"c":"x"},{"c":null}]}}', '{"a":{"b":[{"c":"x"},{}]}}', '{"a":{"b":[]},"e":null}',
        '{"a":{"b":[{"c":"x","d":[1,"2"]},{"c":"y","d":[true]}]}}', '{"a":{"b":[{"c":"x","z z":1},5]},"e":2.0}', '{"a":{},"c: STRING, e":1}',
    ]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, doc string")
    checked = df.select("k", case_schema.schema_issues(F.col("doc"), wanted, ("a.b[].c",)).alias("x"))
    got = {r["k"]: [(i["field"], i["message"]) for i in r["x"]] for r in checked.collect()}
    missing = "a required value is missing"
    assert got == {
        0: [], 1: [("a.b[1].c", missing)], 2: [("a.b[1].c", missing)], 3: [], 4: [("a.b[0].d[1]", "expected a number, found STRING"), ("a.b[1].d[0]", "expected a number, found BOOLEAN")],
        5: [("a.b[0].z z", "not in the schema"), ("a.b[1]", "expected an object, found BIGINT"), ("e", "expected bigint, found DECIMAL")], 6: [("c: STRING, e", "not in the schema")],
    }
    plan = checked._jdf.queryExecution().analyzed().toString()
    assert "schema_of_variant" in plan and "[0]" not in plan


def test_parts_that_must_be_there_are_not_empty(spark):
    rows = ['"x"', "true", '"false"', "7", '{"p":1}', "[0]", "false", "0", "0.0", '""', "null", "{}", "[]"]
    case = lambda v: json.dumps(_case())[:-1].replace('"court": "High"', f'"court": {v}').replace('"summary": {"brief": "In short."}', f'"summary": {v}') + "}"
    df = spark.createDataFrame([(k, case(v)) for k, v in enumerate(rows)], "k int, doc string")
    got = {r["k"]: r["stats"]["missing_top_level"] for r in case_validator.validated(df, "doc", None).collect()}
    assert got == {k: [] if k < 6 else ["court", "summary"] for k in range(len(rows))}
