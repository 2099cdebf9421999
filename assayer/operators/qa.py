"""Validation rules over nested case documents. Each rule is a nullable issue; issues are an array in the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<severity:string,code:string,detail:string>"


def issue(condition: Column, severity: str, code: str, detail: Column | None = None) -> Column:
    """A struct where the condition holds, else null. A null condition is no issue."""
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))
    return F.when(F.coalesce(condition, F.lit(False)), made)


def issues(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def missing(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def none_of(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) <= 0


def orphans(references: Column, ids: Column) -> Column:
    """References to ids that are not there, each once."""
    return F.array_except(F.coalesce(references, F.array().cast("array<string>")), F.coalesce(ids, F.array().cast("array<string>")))


def coverage(references: Column, ids: Column) -> Column:
    """Share of the ids that are referred to; 0 without ids."""
    n = F.size(F.array_distinct(ids))
    return F.when(n > 0, F.size(F.array_intersect(references, ids)) / n).otherwise(0.0)


def case_issues(least_coverage: float = 0.5, least_decisions: int = 2, least_options: int = 2) -> Column:
    """Issues of a case with the columns case_id, court, url, summary, evidence_index, references, decision_points, timeline, taxonomy."""
    ids = F.transform("evidence_index", lambda e: e["evidence_id"])
    lost = orphans(F.col("references"), ids)
    points = F.col("decision_points")
    names = F.transform(points, lambda p: p["decision_id"])
    per_point = F.flatten(F.transform(points, lambda p: issues(
        issue(F.coalesce(F.size(p["options"]), F.lit(0)) < least_options, "error", "INSUFFICIENT_OPTIONS", p["decision_id"]),
        issue(missing(p["actual_action"]), "error", "MISSING_ACTUAL_ACTION", p["decision_id"]),
        issue(missing(p["expected_action"]), "error", "MISSING_EXPECTED_ACTION", p["decision_id"]),
    )))
    whole = issues(
        issue(missing(F.col("case_id")) | missing(F.col("court")) | missing(F.col("url")), "error", "MISSING_REQUIRED"),
        issue(none_of(F.col("evidence_index")), "error", "NO_EVIDENCE"),
        issue(F.size(lost) > 0, "error", "ORPHAN_EVIDENCE_REF", F.array_join(F.array_sort(lost), ",")),
        issue(~none_of(F.col("evidence_index")) & (coverage(F.col("references"), ids) < least_coverage), "warning", "LOW_EVIDENCE_COVERAGE"),
        issue(F.coalesce(F.size(points), F.lit(0)) < least_decisions, "error", "INSUFFICIENT_DECISION_POINTS"),
        issue(F.size(names) != F.size(F.array_distinct(names)), "error", "DUPLICATE_ID"),
        issue(~F.coalesce(F.exists(points, lambda p: p["is_malpractice_point"]), F.lit(False)), "warning", "NO_MALPRACTICE_POINT"),
        issue(none_of(F.col("timeline")), "warning", "EMPTY_TIMELINE"),
        issue(missing(F.col("summary")), "warning", "INCOMPLETE_SUMMARY"),
        issue(none_of(F.col("taxonomy")), "warning", "MISSING_TAXONOMY"),
    )
    return F.concat(whole, F.coalesce(per_point, F.array().cast(f"array<{ISSUE}>")))


def quality(found: Column, covered: Column, complete: Column) -> Column:
    """Coverage .3, completeness .4, decisions .3 less .2 for each error and .1 for each warning, not below 0."""
    errors = F.size(F.filter(found, lambda i: i["severity"] == "error"))
    warnings = F.size(F.filter(found, lambda i: i["severity"] == "warning"))
    return 0.3 * covered + 0.4 * complete + 0.3 * F.greatest(F.lit(0.0), 1 - 0.2 * errors - 0.1 * warnings)


def issue_frequency(df: DataFrame, found: str, k: int = 10) -> DataFrame:
    """The k most frequent codes."""
    return df.select(F.explode(found).alias("i")).groupBy(F.col("i.code").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)


#: Least scores of the grades: fixed names.
GRADES = ((0.8, "excellent"), (0.65, "good"), (0.5, "marginal"), (0.35, "poor"))


def suitability(parts: Sequence[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + value * weight
    return total


def grade(score: Column, grades: Sequence[tuple[float, str]] = GRADES, rest: str = "unsuitable") -> Column:
    out = None
    for least, name in grades:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(rest)


def at_least(df: DataFrame, column: str, least: str, grades: Sequence[tuple[float, str]] = GRADES) -> DataFrame:
    """Rows with at least a grade."""
    names = [name for _, name in grades]
    return df.where(F.col(column).isin(*names[: names.index(least) + 1]))


def quarantine_reason(testable: Column, verdict: Column, breach: Column, evidence: Column, rejected: Sequence[str], patterns: Sequence[str]) -> Column:
    """Why a case goes, null if it stays: untestable, a rejected verdict, no breach, or evidence that speaks against one unless liability was found."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    against = F.lit(False) if not patterns else F.coalesce(evidence.rlike(f"(?i){joined}"), F.lit(False))
    return (
        F.when(testable == F.lit(False), "untestable")
        .when(verdict.isin(*rejected), F.concat(F.lit("verdict:"), verdict))
        .when(breach == F.lit(False), "no_breach")
        .when(against & ~F.coalesce(verdict == "LIABILITY_FOUND", F.lit(False)), "evidence")
    )


def split_by(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to move away."""
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())


def verdict_in_tail(text: Column, for_: str, against: str, share: float = 0.3) -> Column:
    """LIABLE, NOT_LIABLE or UNCLEAR by counts of two patterns in the last share of a text."""
    start = F.floor(F.length(text) * (1 - share)).cast("int") + 1
    tail = F.substr(text, start)
    yes, no = F.regexp_count(tail, F.lit(f"(?i){for_}")), F.regexp_count(tail, F.lit(f"(?i){against}"))
    return F.when(yes > no, "LIABLE").when(no > yes, "NOT_LIABLE").otherwise("UNCLEAR")


def grounded(evidence: Column, source: Column, common: Sequence[str], share: float = 0.5, first: int = 5) -> Column:
    """Whether at least a share of the first distinctive words (five letters or more, not common) stands in the source."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(evidence), F.lit("[a-z]{5,}"), F.lit(0)), lambda w: ~w.isin(*common)))
    picked = F.slice(found, 1, first)
    low = F.lower(source)
    hits = F.size(F.filter(picked, lambda w: F.contains(low, w)))
    return F.when(F.size(picked) > 0, hits / F.size(picked) >= share).otherwise(False)
