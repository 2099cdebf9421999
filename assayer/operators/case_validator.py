"""Validation of whole case documents: 15 codes, counts and scores, in one expression over the JSON text.

Rules read the document by its schema, so a part of another kind counts as missing there and is told by the schema rules. Every
list of evidence ids that the schema knows is held against the evidence index. A text that is no JSON has a schema issue and
counts as an empty document; a null text has no issues of the schema and counts as an empty document as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from assayer.functions.text import let
from assayer.operators.case_schema import NO_ISSUES, all_of, found, none, read_issues

_IDS = "evidence_ids: ARRAY<STRING>"
DOCUMENT = (
    "schema_version STRING, case_id STRING, source STRING, jurisdiction STRING, court STRING, decision_date STRING, url STRING, clinical_domain STRING, "
    "outcome_severity STRING, summary STRUCT<brief: STRING, clinical_synopsis: STRING, legal_synopsis: STRING>, "
    "evidence_index ARRAY<STRUCT<evidence_id: STRING, type: STRING, text: STRING, paragraph_ref: STRING>>, "
    f"simulation STRUCT<initial_state: STRUCT<chief_complaint: STRING, {_IDS}>, "
    f"requestables: ARRAY<STRUCT<request_id: STRING, type: STRING, name: STRING, available_phase: STRING, {_IDS}>>, "
    "timeline_phases: ARRAY<STRUCT<phase_id: STRING, name: STRING, description: STRING>>, "
    "decision_points: ARRAY<STRUCT<decision_id: STRING, phase_id: STRING, prompt: STRING, action_type: STRING, "
    "options: ARRAY<STRUCT<option_id: STRING, description: STRING, is_court_endorsed: BOOLEAN, is_defendant_choice: BOOLEAN>>, "
    f"actual_action_defendant: STRUCT<description: STRING, {_IDS}>, expected_action_court: STRUCT<description: STRING, {_IDS}>, "
    "scoring_rubric: STRUCT<max_score: DOUBLE>, is_malpractice_point: BOOLEAN>>, "
    f"end_state: STRUCT<patient_outcome: STRUCT<description: STRING, {_IDS}>, legal_outcome: STRUCT<verdict: STRING, {_IDS}>, "
    f"malpractice_determination: STRUCT<breach_found: BOOLEAN, {_IDS}>>>, "
    f"ground_truth STRUCT<factual_timeline: ARRAY<STRUCT<timestamp: STRING, event: STRING, {_IDS}>>, "
    f"tests_performed: ARRAY<STRUCT<test_name: STRING, result: STRING, {_IDS}>>>, "
    "taxonomy_labels STRUCT<malpractice_categories: ARRAY<STRING>>, quality STRUCT<evidence_coverage_score: DOUBLE, validation_passed: BOOLEAN>"
)
#: The document as the rules read it: parts that only have to be there are read as text, so that other kinds of values cost no failed reading.
READ = DOCUMENT.replace("quality STRUCT<evidence_coverage_score: DOUBLE, validation_passed: BOOLEAN>", "quality STRUCT<evidence_coverage_score: STRING, validation_passed: STRING>").replace(
    "scoring_rubric: STRUCT<max_score: DOUBLE>, ", ""
)
# The fields that a document must have, and the codes that make it invalid even where rules are lenient.
REQUIRED = (
    "case_id", "source", "jurisdiction", "court", "decision_date", "url", "clinical_domain", "outcome_severity",
    "summary", "evidence_index", "simulation", "ground_truth", "taxonomy_labels", "quality",
)
GRAVE = ("SCHEMA_ERROR", "MISSING_REQUIRED", "INVALID_REFERENCE")
#: Issues of the schema and of lost references that are told of a document, and the share of evidence that should be referred to.
MOST_TOLD, LEAST_COVERAGE = 10, 0.5


def _empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _count(items: Column) -> Column:
    return F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0))


def references(value: Column, kind: DataType) -> Column:
    """Every evidence id that a part of a document refers to, in the order of the schema."""
    nothing = F.array().cast("array<string>")
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: references(x, kind.elementType))), nothing)
    parts = []
    for f in kind.fields if isinstance(kind, StructType) else ():
        if f.name == "evidence_ids":
            parts.append(F.coalesce(value[f.name], nothing))
        elif isinstance(f.dataType, (StructType, ArrayType)):
            parts.append(references(value[f.name], f.dataType))
    return F.flatten(F.array(*parts)) if parts else nothing


def lost_references(value: Column, kind: DataType, path: Column, ids: Column) -> Column:
    """field, id of every reference to an id that is not there, in the order of the schema; places are told of these alone."""
    pair = "array<struct<field:string,id:string>>"
    nothing = F.array().cast(pair)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: lost_references(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), ids))), nothing)
    parts = []
    for f in kind.fields if isinstance(kind, StructType) else ():
        at = F.concat(path, F.lit(f".{f.name}"))
        if f.name == "evidence_ids":
            lost = F.filter(value[f.name], lambda x: ~F.coalesce(F.array_contains(ids, x), F.lit(False)))
            parts.append(F.coalesce(F.transform(lost, _at(at)), nothing))
        elif isinstance(f.dataType, (StructType, ArrayType)):
            parts.append(lost_references(value[f.name], f.dataType, at, ids))
    return F.flatten(F.array(*parts)) if parts else nothing


def _at(path: Column) -> Callable[[Column], Column]:
    return lambda x: F.struct(path.alias("field"), x.alias("id"))


def _repeated(ids: Column, field: str, name: str, what: str) -> Column:
    """An issue for each id that an earlier element has as well; missing ids are equal."""
    at = lambda i: F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"].{name}"))
    told = lambda x: F.concat(F.lit(f"Duplicate {what} ID: "), F.coalesce(x, F.lit("None")))
    return F.transform(ids, lambda x, i: found(F.exists(F.slice(ids, F.lit(1), i), lambda y: y.eqNullSafe(x)), "error", "DUPLICATE_ID", at(i), told(x)))


def _truthy(doc: Column, name: str) -> Column:
    """Whether a part of a document is there and neither empty, false nor zero."""
    value = F.try_variant_get(doc, f"$.{name}", "variant")
    return F.coalesce(~F.is_variant_null(value) & ~F.to_json(value).isin('""', "[]", "{}", "false", "0", "0.0"), F.lit(False))


def _there(doc: Column, part: Column, name: str, kind: DataType) -> Column:
    """_truthy, told by the part as the schema reads it where this is enough, as large parts need not be written again for it."""
    if isinstance(kind, StructType):
        sure = reduce(or_, [part[f.name].isNotNull() for f in kind.fields])
    elif isinstance(kind, ArrayType):
        sure = F.size(part) > 0
    else:
        sure = part.rlike("^[A-Za-z]") & (part != "false")
    return F.when(doc.isNotNull() & sure, F.lit(True)).otherwise(_truthy(doc, name))


def _point_issues(points: Column, seen: Column) -> Column:
    def one(p: Column, i: Column) -> Column:
        path = F.concat(F.lit("simulation.decision_points["), i.cast("string"), F.lit("]"))
        at = lambda end: F.concat(path, F.lit(end))
        actual, expected = p["actual_action_defendant"], p["expected_action_court"]
        return all_of(
            seen[i],
            found(_count(p["options"]) < 2, "error", "INSUFFICIENT_OPTIONS", at(".options"), "Decision point must have at least 2 options"),
            found(_empty(actual["description"]), "error", "MISSING_ACTUAL_ACTION", at(".actual_action_defendant"), "Missing defendant's actual action"),
            found(_empty(expected["description"]), "error", "MISSING_EXPECTED_ACTION", at(".expected_action_court"), "Missing court's expected action"),
            found(_count(actual["evidence_ids"]) == 0, "warning", "NO_EVIDENCE", at(".actual_action_defendant.evidence_ids"), "Actual action has no evidence citations"),
            found(_count(expected["evidence_ids"]) == 0, "warning", "NO_EVIDENCE", at(".expected_action_court.evidence_ids"), "Expected action has no evidence citations"),
        )

    return F.flatten(F.transform(points, one))


def validated(cases: DataFrame, text: str, expected: str | None = DOCUMENT, required: tuple[str, ...] = ()) -> DataFrame:
    """Adds issues (severity, code, field, message), stats, scores, valid and valid_lenient; expected None leaves the schema rules out."""
    document = StructType.fromDDL(READ)
    step = cases.withColumns({"_c": F.from_json(F.col(text), READ), "_v": F.try_parse_json(F.col(text))})
    c, sim, truth = F.col("_c"), F.col("_c.simulation"), F.col("_c.ground_truth")
    points, timeline, asked = sim["decision_points"], truth["factual_timeline"], sim["requestables"]
    index = F.array_distinct(F.filter(F.transform(c["evidence_index"], lambda e: e["evidence_id"]), lambda x: ~_empty(x)))
    step = step.withColumn("_ids", F.coalesce(index, F.array().cast("array<string>")))
    known = F.array_intersect(references(c, document), F.col("_ids"))
    step = step.withColumns({
        "_share": F.when(F.size("_ids") > 0, F.size(known) / F.size("_ids")),
        "_lost": lost_references(c, document, F.lit(""), F.col("_ids")),
        "_seen": F.coalesce(_repeated(F.transform(points, lambda p: p["decision_id"]), "simulation.decision_points", "decision_id", "decision"), F.array().cast(f"array<{NO_ISSUES}>")),
    })
    lost = F.transform("_lost", lambda r: found(F.lit(True), "error", "ORPHAN_EVIDENCE_REF", r["field"], F.concat(F.lit("Evidence ID '"), F.coalesce(r["id"], F.lit("None")), F.lit("' not found in evidence index"))))
    percent = F.bround(F.col("_share") * 100, 0).cast("int").cast("string")
    names = F.array().cast("array<string>")
    gone = F.concat(*[F.when(_there(F.col("_v"), c[n], n, document[n].dataType), names).otherwise(F.array(F.lit(n))) for n in REQUIRED])
    step = step.withColumn("_gone", gone)
    schema = F.slice(read_issues(F.col(text), F.col("_v"), StructType.fromDDL(expected), required), 1, MOST_TOLD) if expected is not None else none()
    no_events = F.transform(timeline, lambda e, i: found(
        _count(e["evidence_ids"]) == 0, "warning", "NO_EVIDENCE", F.concat(F.lit("ground_truth.factual_timeline["), i.cast("string"), F.lit("].evidence_ids")),
        F.concat(F.lit("Timeline event has no evidence: "), F.substring(F.coalesce(e["event"], F.lit("")), 1, 50)),
    ))
    guilty = _count(F.filter(points, lambda p: F.coalesce(p["is_malpractice_point"], F.lit(False))))
    found_all = all_of(
        schema,
        F.slice(F.flatten(lost), 1, MOST_TOLD),
        found(F.col("_share") < LEAST_COVERAGE, "warning", "LOW_EVIDENCE_COVERAGE", "evidence_index", F.concat(F.lit("Only "), percent, F.lit("% of evidence items are referenced"))),
        found(_empty(sim["initial_state"]["chief_complaint"]), "error", "MISSING_REQUIRED", "simulation.initial_state.chief_complaint", "Initial state must have chief complaint"),
        found(_count(sim["initial_state"]["evidence_ids"]) == 0, "warning", "NO_EVIDENCE", "simulation.initial_state.evidence_ids", "Initial state has no evidence citations"),
        found(_count(points) < 2, "error", "INSUFFICIENT_DECISION_POINTS", "simulation.decision_points", F.concat(F.lit("Need at least 2 decision points, found "), _count(points).cast("string"))),
        found(~_outcome("patient_outcome"), "error", "MISSING_REQUIRED", "simulation.end_state.patient_outcome", "End state must have patient outcome"),
        found(~_outcome("legal_outcome"), "error", "MISSING_REQUIRED", "simulation.end_state.legal_outcome", "End state must have legal outcome"),
        _point_issues(points, F.col("_seen")),
        found((guilty == 0) & (_count(points) > 0), "warning", "NO_MALPRACTICE_POINT", "simulation.decision_points", "No decision point marked as malpractice point"),
        found(_count(timeline) == 0, "warning", "EMPTY_TIMELINE", "ground_truth.factual_timeline", "No factual timeline events"),
        F.flatten(no_events),
        F.flatten(_repeated(F.transform(asked, lambda r: r["request_id"]), "simulation.requestables", "request_id", "request")),
        F.flatten(F.transform("_gone", lambda n: found(F.lit(True), "error", "MISSING_REQUIRED", n, F.concat(F.lit("Required field '"), n, F.lit("' is missing or empty"))))),
        found(_empty(c["summary"]["brief"]), "warning", "INCOMPLETE_SUMMARY", "summary.brief", "Summary brief is empty"),
        found(_count(c["taxonomy_labels"]["malpractice_categories"]) == 0, "error", "MISSING_TAXONOMY", "taxonomy_labels.malpractice_categories", "No malpractice categories specified"),
    )
    step = step.withColumn("issues", found_all)

    of = lambda severity: F.size(F.filter("issues", lambda i: (i["severity"] == severity) & i["field"].rlike("(?i)decision")))
    steps = lambda n, full, half: F.when(n >= full, 1.0).when(n >= half, 0.5).otherwise(0.0)
    whole = (
        F.when(_empty(sim["initial_state"]["chief_complaint"]), 0.0).otherwise(1.0) + steps(_count(points), 2, 1) + steps(_count(asked), 3, 1) + steps(_count(timeline), 5, 2)
        + steps(_outcome("patient_outcome").cast("int") + _outcome("legal_outcome").cast("int"), 2, 1)
    ) / 5
    covered = F.coalesce("_share", F.lit(0.0))
    quality = F.when(_count(points) > 0, F.greatest(F.lit(0.0), 1 - (0.2 * of("error") + 0.1 * of("warning")))).otherwise(0.0)
    scores = F.struct(covered.alias("evidence_coverage"), whole.alias("simulation_completeness"), quality.alias("decision_point_quality"))
    errors = F.filter("issues", lambda i: i["severity"] == "error")
    stats = F.struct(
        F.size("_ids").alias("evidence_count"), F.col("_share").alias("evidence_coverage"), _count(points).alias("decision_point_count"), guilty.alias("malpractice_points"),
        _count(timeline).alias("timeline_events"), _count(asked).alias("requestable_count"), F.col("_gone").alias("missing_top_level"),
    )
    step = step.withColumns({
        "stats": stats, "scores": let(scores, lambda s: s.withField("overall", s["evidence_coverage"] * 0.3 + s["simulation_completeness"] * 0.4 + s["decision_point_quality"] * 0.3)),
        "valid": F.size(errors) == 0, "valid_lenient": ~F.exists(errors, lambda i: i["code"].isin(*GRAVE)),
    })
    return step.drop("_c", "_v", "_ids", "_share", "_lost", "_seen", "_gone")


def _outcome(name: str) -> Column:
    return _truthy(F.col("_v"), f"simulation.end_state.{name}")
