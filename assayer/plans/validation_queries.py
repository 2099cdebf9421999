"""Queries that validate case documents, written as JSON from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators import case_schema, case_validator
from assayer.plans.tables import read


def case_documents(spark, sf_dir):
    """o_orderkey, doc: each order as a case; its lines are evidence (not the N ones), decisions (taxed), requests (discounted) and events."""
    line = lambda name: F.col(f"l_{name}")
    number, evidence = line("linenumber"), lambda k: F.array(F.concat(F.lit("E"), k.cast("string")))
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    later = F.when(line("linestatus") == "F", F.array().cast("array<string>")).otherwise(evidence(number + 1))
    decision = F.struct(
        F.concat(F.lit("D"), F.floor(line("quantity") / 10).cast("string")).alias("decision_id"),
        F.transform(F.sequence(F.lit(0), F.floor(line("discount") * 50).cast("int")), lambda k: F.struct(k.cast("string").alias("option_id"))).alias("options"),
        F.struct(F.when(line("returnflag") == "R", "").otherwise(line("returnflag")).alias("description"), evidence(number).alias("evidence_ids")).alias("actual_action_defendant"),
        F.struct(line("linestatus").alias("description"), later.alias("evidence_ids")).alias("expected_action_court"),
        (line("quantity") > 40).alias("is_malpractice_point"),
    )
    kept = lambda rows: F.sort_array(F.collect_list(rows))
    parts = lines.groupBy("o_orderkey").agg(
        kept(F.when(line("returnflag") != "N", F.struct(number.alias("n"), F.struct(evidence(number)[0].alias("evidence_id"), line("returnflag").alias("text")).alias("x")))).alias("found"),
        kept(F.when(line("tax") >= 0.03, F.struct(number.alias("n"), line("partkey"), decision.alias("x")))).alias("points"),
        kept(F.when(line("discount") >= 0.05, F.struct(number.alias("n"), F.struct(F.concat(F.lit("R"), F.floor(number / 2).cast("string")).alias("request_id")).alias("x")))).alias("asked"),
        kept(F.struct(number.alias("n"), F.struct(line("shipdate").cast("string").alias("event"), evidence(number).alias("evidence_ids")).alias("x"))).alias("events"),
    )
    orders = read(spark, sf_dir, "orders").join(parts, "o_orderkey", "left")
    only, price, status = lambda name: F.transform(name, lambda r: r["x"]), F.col("o_totalprice"), F.col("o_orderstatus")
    whole = F.struct(
        F.col("o_orderkey").cast("string").alias("case_id"), status.alias("source"), F.col("o_orderpriority").alias("jurisdiction"),
        F.when(price >= 50_000, "High").alias("court"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("decision_date"), F.lit("https://x.org").alias("url"),
        status.alias("clinical_domain"), status.alias("outcome_severity"), F.struct(F.when(status == "P", "").otherwise(status).alias("brief")).alias("summary"),
        only("found").alias("evidence_index"),
        F.struct(
            F.struct(F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("chief_complaint"), F.array(F.lit("E1")).alias("evidence_ids")).alias("initial_state"),
            only("asked").alias("requestables"), only("points").alias("decision_points"),
            F.struct(
                F.struct(F.when(price < 400_000, status).alias("description")).alias("patient_outcome"),
                F.when(price >= 100_000, F.struct(status.alias("verdict"))).alias("legal_outcome"),
            ).alias("end_state"),
        ).alias("simulation"),
        F.struct(only("events").alias("factual_timeline")).alias("ground_truth"),
        F.struct(F.when(status != "O", F.array(status)).alias("malpractice_categories")).alias("taxonomy_labels"),
        F.struct(F.when(price < 450_000, F.to_json(F.struct(price))).alias("validation_passed"), F.when(price >= 450_000, price).alias("evidence_coverage_score")).alias("quality"),
        F.when(status == "F", F.struct(price)).alias("remark"),
    )
    return orders.select("o_orderkey", F.to_json(whole).alias("doc"))


def case_issues(spark, sf_dir):
    """Every document with its issues by code, its scores and its verdicts."""
    told = case_validator.validated(case_documents(spark, sf_dir), "doc", required=("simulation.decision_points[].options",))
    codes = F.sort_array(F.transform("issues", lambda i: i["code"]))
    return told.select(
        "o_orderkey", F.array_join(codes, ",").alias("codes"), "valid", "valid_lenient",
        (F.round("scores.evidence_coverage", 6) + 0.0).alias("evidence_coverage"), (F.round("scores.simulation_completeness", 6) + 0.0).alias("completeness"),
        (F.round("scores.decision_point_quality", 6) + 0.0).alias("quality"), (F.round("scores.overall", 6) + 0.0).alias("overall"),
    )


def props_drift(spark, sf_dir):
    """The properties of all events against a schema that they do not keep to: kinds and missing parts by path."""
    events = read(spark, sf_dir, "events")
    wanted = StructType.fromDDL("k BOOLEAN, user STRUCT<id: BIGINT>")
    told = events.select("event_type", F.explode(case_schema.schema_issues(F.col("props"), wanted, ("user",))).alias("i"))
    return told.groupBy("event_type", F.col("i.field").alias("field"), F.col("i.message").alias("message"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (case_issues, props_drift)}
ORACLES = {
    "case_issues": """WITH l AS (
  SELECT l_orderkey AS k, l_linenumber AS n, 'E' || l_linenumber AS e, l_returnflag <> 'N' AS evidence, l_tax >= 0.03 AS point, l_discount >= 0.05 AS asked, 'D' || floor(l_quantity / 10)::INT AS d,
         floor(l_discount * 50)::INT + 1 AS options, l_returnflag = 'R' AS silent, l_linestatus = 'F' AS uncited, l_quantity > 40 AS guilty, l_partkey AS part FROM lineitem),
point AS (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY n, part) > 1 AS again FROM l WHERE point),
asked AS (SELECT k, count(*) AS requests, count(*) - count(DISTINCT n // 2) AS same_request FROM l WHERE asked GROUP BY k),
known AS (SELECT DISTINCT k, e FROM l WHERE evidence),
ref AS (SELECT o_orderkey AS k, 'E1' AS e FROM orders UNION ALL SELECT k, e FROM point UNION ALL SELECT k, 'E' || (n + 1) FROM point WHERE NOT uncited UNION ALL SELECT k, e FROM l),
refs AS (SELECT r.k, count(*) FILTER (known.e IS NULL) AS lost, count(DISTINCT known.e) AS met FROM ref r LEFT JOIN known ON known.k = r.k AND known.e = r.e GROUP BY r.k),
p AS (SELECT k, count(*) AS points, count(*) FILTER (again) AS same_point, count(*) FILTER (options < 2) AS few, count(*) FILTER (silent) AS silent, count(*) FILTER (uncited) AS uncited, bool_or(guilty) AS guilty FROM point GROUP BY k),
lines AS (SELECT k, count(*) AS events FROM l GROUP BY k),
ids AS (SELECT k, count(*) AS ids FROM known GROUP BY k),
o AS (
  SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS status, o_orderpriority LIKE '4%' AS mute, coalesce(ids, 0) AS ids, coalesce(met, 0) AS met, least(coalesce(lost, 0), 10) AS lost,
         coalesce(points, 0) AS points, coalesce(same_point, 0) AS same_point, coalesce(few, 0) AS few, coalesce(silent, 0) AS silent, coalesce(uncited, 0) AS uncited, coalesce(guilty, false) AS guilty,
         coalesce(requests, 0) AS requests, coalesce(same_request, 0) AS same_request, coalesce(events, 0) AS events
  FROM orders LEFT JOIN refs ON refs.k = o_orderkey LEFT JOIN p ON p.k = o_orderkey LEFT JOIN lines ON lines.k = o_orderkey LEFT JOIN ids ON ids.k = o_orderkey LEFT JOIN asked ON asked.k = o_orderkey),
-- each code as often as it is met; (kind of field, errors and warnings that name a decision) beside it
c AS (
  SELECT *, [
    repeat('DUPLICATE_ID,', same_point + same_request), repeat('EMPTY_TIMELINE,', (events = 0)::INT), repeat('INCOMPLETE_SUMMARY,', (status = 'P')::INT),
    repeat('INSUFFICIENT_DECISION_POINTS,', (points < 2)::INT), repeat('INSUFFICIENT_OPTIONS,', few), repeat('LOW_EVIDENCE_COVERAGE,', (ids > 0 AND met / ids < 0.5)::INT),
    repeat('MISSING_ACTUAL_ACTION,', silent), repeat('MISSING_REQUIRED,', (price < 50000)::INT + mute::INT + (price >= 400000)::INT + (price < 100000)::INT + (ids = 0)::INT + (status = 'O')::INT + (events = 0)::INT),
    repeat('MISSING_TAXONOMY,', (status = 'O')::INT), repeat('NO_EVIDENCE,', uncited), repeat('NO_MALPRACTICE_POINT,', (points > 0 AND NOT guilty)::INT),
    repeat('ORPHAN_EVIDENCE_REF,', lost), repeat('SCHEMA_ERROR,', (price < 450000)::INT + (status = 'F')::INT)] AS codes,
    CASE WHEN ids > 0 THEN met / ids ELSE 0.0 END AS covered,
    ((NOT mute)::INT + CASE WHEN points >= 2 THEN 1 WHEN points = 1 THEN 0.5 ELSE 0 END + CASE WHEN requests >= 3 THEN 1 WHEN requests >= 1 THEN 0.5 ELSE 0 END
     + CASE WHEN events >= 5 THEN 1 WHEN events >= 2 THEN 0.5 ELSE 0 END + ((price < 400000)::INT + (price >= 100000)::INT) / 2) / 5 AS complete
  FROM o),
-- of lost references, in order: the start's, then those of the decisions
lost AS (
  SELECT k, count(*) FILTER (place BETWEEN 1 AND 2 AND nth <= 10) AS of_points FROM (
    SELECT x.k, x.place, row_number() OVER (PARTITION BY x.k ORDER BY (x.place = 3)::INT, (x.place <> 0)::INT, n, part, x.place) AS nth
    FROM (SELECT o_orderkey AS k, 'E1' AS e, 0 AS n, 0 AS part, 0 AS place FROM orders UNION ALL SELECT k, e, n, part, 1 FROM point
          UNION ALL SELECT k, 'E' || (n + 1), n, part, 2 FROM point WHERE NOT uncited UNION ALL SELECT k, e, n, part, 3 FROM l) x
    LEFT JOIN known ON known.k = x.k AND known.e = x.e WHERE known.e IS NULL) GROUP BY k),
s AS (
  SELECT c.*, CASE WHEN points = 0 THEN 0.0 ELSE greatest(0.0, 1 - (0.2 * (coalesce(of_points, 0) + (points < 2)::INT + same_point + few + silent) + 0.1 * (uncited + (NOT guilty)::INT))) END AS quality
  FROM c LEFT JOIN lost ON lost.k = c.o_orderkey)
SELECT o_orderkey, rtrim(array_to_string(codes, ''), ',') AS codes,
       same_point + same_request + few + silent + lost + (points < 2)::INT + (price < 450000)::INT + (status = 'O')::INT + mute::INT + (price < 100000)::INT + (price >= 400000)::INT + (ids = 0)::INT + (events = 0)::INT = 0 AS valid,
       NOT (price < 450000 OR mute OR price < 100000 OR price >= 400000 OR ids = 0 OR status = 'O' OR events = 0) AS valid_lenient,
       round(covered, 6) + 0.0 AS evidence_coverage, round(complete, 6) + 0.0 AS completeness, round(quality, 6)::DOUBLE + 0.0 AS quality,
       round(covered * 0.3 + complete * 0.4 + quality * 0.3, 6) + 0.0 AS overall FROM s""",
    "props_drift": """WITH e AS (SELECT event_type, json_type(props, '$.k') AS k, json_type(props, '$.user') AS u FROM events)
SELECT event_type, 'k' AS field, 'expected boolean, found ' || CASE WHEN k = 'UBIGINT' THEN 'BIGINT' ELSE k END AS message, 'error' AS severity, count(*) AS n FROM e WHERE k <> 'BOOLEAN' GROUP BY ALL
UNION ALL SELECT event_type, 'user', 'a required value is missing', 'error', count(*) FROM e WHERE u IS NULL GROUP BY ALL""",
}
