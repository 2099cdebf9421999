"""Nested cases: access to their parts, repair of extracted values, validity and filters, and simulations over decisions.

Cases are rows with arrays of structs (decision points, requests, evidence). Every function is a Column over one row, or a
join by key, so nothing is exploded unless a result has a row for each element.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from assayer.functions.text import mentions

#: Phases of a case in their order, and other names for them: fixed values.
PHASES = ("presentation", "workup", "decision", "procedure", "postop", "followup")
PHASE_NAMES = {
    "preoperative": "workup", "pre-operative": "workup", "perioperative": "procedure", "intraoperative": "procedure",
    "intra-operative": "procedure", "post-operative": "postop", "recovery": "postop", "discharge": "followup",
}
#: Actions, requests and verdicts, and other names for them: fixed values.
ACTIONS = (
    "ORDER_TEST", "CHOOSE_MANAGEMENT", "DISCLOSE_ALTERNATIVES", "COUNSEL_RISKS", "SELECT_TECHNIQUE", "ESCALATE_CARE",
    "DOCUMENT_CONSENT", "REFER", "PRESCRIBE", "DISCHARGE_DECISION",
)
ACTION_NAMES = {
    "not documented in judgment": "CHOOSE_MANAGEMENT", "unknown": "CHOOSE_MANAGEMENT", "diagnose": "ORDER_TEST",
    "treat": "CHOOSE_MANAGEMENT", "surgery": "SELECT_TECHNIQUE", "consent": "DOCUMENT_CONSENT",
}
REQUESTS = (
    "LAB", "IMAGING", "PATHOLOGY", "CONSULT_NOTE", "MDT_NOTE", "OP_NOTE", "CONSENT_DISCUSSION", "FOLLOWUP", "VITAL_SIGNS",
    "NURSING_NOTES", "PROCEDURE_NOTE",
)
REQUEST_NAMES = {
    "medication": "CONSULT_NOTE", "test": "LAB", "scan": "IMAGING", "xray": "IMAGING", "x-ray": "IMAGING", "mri": "IMAGING",
    "ct": "IMAGING", "blood": "LAB", "biopsy": "PATHOLOGY", "consult": "CONSULT_NOTE", "referral": "CONSULT_NOTE",
}
VERDICTS = ("LIABILITY_FOUND", "NO_LIABILITY", "PARTIAL_LIABILITY", "SETTLED", "UNKNOWN")
VERDICT_NAMES = {"LIABILITY_NOT_FOUND": "NO_LIABILITY", "NOT_FOUND": "NO_LIABILITY", "FOUND": "LIABILITY_FOUND", "PARTIAL": "PARTIAL_LIABILITY"}


def place_of(phase: Column, phases: Sequence[str] = PHASES) -> Column:
    """The place of a phase in their order, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, phases)), phase), F.lit(0)) - 1


def available(requests: Column, phase: Column, phases: Sequence[str] = PHASES) -> Column:
    """The requests (with available_phase) that are open in a phase: those of earlier phases and of none that is known; null counts as the first."""
    now = place_of(phase, phases)
    return F.filter(requests, lambda r: F.coalesce(place_of(F.coalesce(r["available_phase"], F.lit(phases[0])), phases) <= now, F.lit(True)))


def flagged(items: Column, field: str) -> Column:
    """The items whose field is true."""
    return F.filter(items, lambda x: F.coalesce(x[field], F.lit(False)))


def having(items: Column, field: str, value: Column | str) -> Column:
    """The items whose field has a value."""
    return F.filter(items, lambda x: x[field] == value)


def by_id(items: Column, field: str, value: Column | str) -> Column:
    """The first item whose field has a value; null if there is none."""
    return F.get(having(items, field, value), 0)


def first_filled(items: Column, field: str, default: str | None = None) -> Column:
    """The first value of a field over the items that is neither null nor empty."""
    return F.coalesce(F.get(F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), 0), F.lit(default))


def at_path(df: DataFrame, path: str, default=None) -> Column:
    """The value at a dotted path of nested columns, or the default where it or anything on the way is null or not in the schema."""
    kind, known = df.schema, True
    for name in path.split("."):
        known = isinstance(kind, StructType) and name in kind.names
        if not known:
            return F.lit(default)
        kind = kind[name].dataType
    return F.coalesce(F.col(path), F.lit(default))


def picked(df: DataFrame, key: str, seed: int, domain: Column | None = None) -> DataFrame:
    """One row, the one with the least hash of key and seed, of those in a domain if one is given: a top-1, not a sort."""
    among = df if domain is None else df.where(domain)
    return among.orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)


def shown(df: DataFrame, names: Mapping[str, str], digits: int = 2) -> DataFrame:
    """The columns under new names, numbers rounded."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(F.round(c, digits) if isinstance(kinds[c], NumericType) else F.col(c)).alias(n) for c, n in names.items()])


def repaired(col: Column, valid: Sequence[str], names: Mapping[str, str], default: str, fold: Callable[[Column], Column] = F.lower) -> Column:
    """A value that is one of the valid ones, else what its folded form is another name for, else the default."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(col.isin(*valid), col).otherwise(F.coalesce(table[fold(col)], F.lit(default)))


def repaired_phase(col: Column) -> Column:
    """Phases are folded before they are compared; a valid one stays as it is written."""
    return F.when(F.lower(col).isin(*PHASES), col).otherwise(repaired(F.lower(col), PHASES, PHASE_NAMES, "decision"))


def repaired_action(col: Column) -> Column:
    return repaired(F.coalesce(col, F.lit("CHOOSE_MANAGEMENT")), ACTIONS, ACTION_NAMES, "CHOOSE_MANAGEMENT")


def repaired_request(col: Column) -> Column:
    return repaired(F.coalesce(col, F.lit("LAB")), REQUESTS, REQUEST_NAMES, "CONSULT_NOTE")


def repaired_verdict(col: Column) -> Column:
    return repaired(F.coalesce(col, F.lit("UNKNOWN")), VERDICTS, VERDICT_NAMES, "UNKNOWN", lambda c: c)


OPTIONS = (("A", "Standard of care action"), ("B", "Alternative action"))


def repaired_points(points: Column, max_score: float = 10.0) -> Column:
    """Decision points (phase_id, action_type, options (option_id, description), max_score) with valid values, two options at least and a score."""
    filled = F.array(*[F.struct(F.lit(a).alias("option_id"), F.lit(b).alias("description")) for a, b in OPTIONS])

    def repair(p: Column) -> Column:
        p = p.withField("phase_id", repaired_phase(F.coalesce(p["phase_id"], F.lit("")))).withField("action_type", repaired_action(p["action_type"]))
        enough = F.coalesce(F.size(p["options"]), F.lit(0)) >= 2
        return p.withField("options", F.when(enough, p["options"]).otherwise(filled)).withField("max_score", F.coalesce(p["max_score"], F.lit(max_score)))

    return F.transform(points, repair)


def with_case(logs: DataFrame, cases: DataFrame, second: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """logs with columns of their case, from a second table where the first has none; logs without a case are left out."""
    first, other = ([F.col(key), F.struct(*columns).alias(n)] for n in ("_one", "_two"))
    met = logs.join(cases.select(*first), key, "left").join(second.select(*other), key, "left")
    found = met.withColumn("_case", F.coalesce("_one", "_two")).where("_case IS NOT NULL")
    return found.select(*logs.columns, *[F.col("_case")[c].alias(c) for c in columns])


def with_request(responses: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """responses with their request's columns and `orphan`, true where no request has the key."""
    known = mapping.withColumn("_known", F.lit(True))
    return responses.join(known, key, "left").withColumn("orphan", F.col("_known").isNull()).drop("_known")


def reused(now: DataFrame, before: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The values before (key and values) of rows that are there now, and those that compute gives for the rows without one."""
    kept = before.join(now.select(key), key, "left_semi")
    return kept.unionByName(compute(now.join(before.select(key), key, "left_anti")).select(*before.columns))


def combined_text(parts: DataFrame, key: str, order: str, fields: Sequence[str], between: str = "\n\n---\n\n") -> DataFrame:
    """key, text: the first filled field of each part, the parts' texts in order with a line between them."""
    text = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    joined = parts.select(key, F.struct(F.col(order).alias("at"), text.alias("text")).alias("p")).where("p.text IS NOT NULL").groupBy(key)
    return joined.agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]), between).alias("text"))


def replayed(points: Column, choices: Column) -> Column:
    """For each decision point (decision_id, endorsed, defendant, max_score) the choice made, by default the endorsed one, and what it scores."""

    def judged(p: Column, k: Column) -> Column:
        chosen = F.coalesce(F.get(choices, k), p["endorsed"])
        court = F.coalesce(chosen == p["endorsed"], F.lit(False))
        return F.struct(
            p["decision_id"].alias("decision_id"), chosen.alias("chosen"), court.alias("matched_court"),
            F.coalesce(chosen == p["defendant"], F.lit(False)).alias("matched_defendant"),
            F.when(court, p["max_score"]).otherwise(0.0).alias("score"), p["max_score"].alias("max_score"),
        )

    return F.transform(points, judged)


def totals(results: Column) -> list[Column]:
    """total_score, max_score, percentage, decisions, court_matches and defendant_matches of replayed decisions."""
    summed = lambda f: F.aggregate(results, F.lit(0.0), lambda n, r: n + r[f])
    many = lambda f: F.size(F.filter(results, lambda r: r[f]))
    percent = F.when(summed("max_score") > 0, summed("score") / summed("max_score") * 100).otherwise(0.0)
    return [
        summed("score").alias("total_score"), summed("max_score").alias("max_score"), percent.alias("percentage"),
        F.size(results).alias("decisions"), many("matched_court").alias("court_matches"), many("matched_defendant").alias("defendant_matches"),
    ]


#: Words of questions about symptoms, and the answers of a patient who gets worse: fixed values.
SYMPTOM_WORDS = ("pain", "feel", "symptom", "worse", "better", "how are you")
WORSE = "Actually, it's gotten worse. The pain is more severe now and I feel more unwell than before."


def evolved_reply(question: Column, trajectory: Column, minutes: Column) -> Column:
    """The answer to a question about symptoms after an hour of getting worse, else null. No later answer exists: an hour is always met first."""
    return F.when((trajectory == "worsening") & mentions(question, SYMPTOM_WORDS) & (minutes > 60), WORSE)


#: Phrases that a response must share with the description of what was done wrong: fixed values.
CONDUCT = (
    "reassure without", "proceed without informing", "not discuss risk", "skip the", "omit the", "without warning about",
    "without informing about", "no need for",
)


def resembles_conduct(response: Column, descriptions: Column, met: Column, criteria: Column, phrases: Sequence[str] = CONDUCT) -> Column:
    """Whether a response has a phrase of the conduct described; never where at least half of the criteria are met."""
    low = F.lower(response)
    shared = F.exists(descriptions, lambda d: F.coalesce(F.greatest(*[(F.lower(d).contains(p) & low.contains(p)).cast("int") for p in phrases]) == 1, F.lit(False)))
    return ~F.coalesce((criteria > 0) & (met / F.nullif(criteria, F.lit(0)) >= 0.5), F.lit(False)) & F.coalesce(shared, F.lit(False))


#: Signs of cases that are not clinical: fixed values.
NAME_SIGNS = ("drug store", "drugstore", "pharmacy", "pharmacist", "beauty lab", "beauty salon", "laser clinic", "genedx", "chemist")
DEFENDANT_SIGNS = ("drug store", "drugstore", "pharmacy", "pharmacist", "beauty lab", "beauty salon", "bank", "the bank", "genedx", "chemist")
EVIDENCE_SIGNS = ("incarceration", "arrested", "convicted", "criminal conviction", "fca", "approved person", "contract of employment", "redundant")
DECISION_SIGNS = ("dispensing medication", "what should be verified before dispensing")


def not_clinical(name: Column, against: Column, points: Column, evidence: Column) -> Column:
    """Whether a case is not clinical: by its name, whom the allegations are against, its decision points (clinical_context, prompt) or its first five evidence texts."""

    def of_point(p: Column) -> Column:
        context, prompt = F.lower(F.coalesce(p["clinical_context"], F.lit(""))), F.lower(F.coalesce(p["prompt"], F.lit("")))
        return (
            mentions(context, DECISION_SIGNS) | mentions(prompt, DECISION_SIGNS)
            | (context.contains("dispens") & context.contains("pharmacy"))
            | (context.contains("genetic test") & context.contains("lab"))
            | (prompt.contains("confirmatory test") & context.contains("genetic"))
        )

    return (
        mentions(name, NAME_SIGNS)
        | F.coalesce(F.exists(against, lambda a: mentions(a, DEFENDANT_SIGNS)), F.lit(False))
        | F.coalesce(F.exists(points, of_point), F.lit(False))
        | mentions(F.array_join(F.slice(F.transform(evidence, lambda e: e["text"]), 1, 5), " "), EVIDENCE_SIGNS)
    )


def _empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def _no_point(points: Column) -> Column:
    return ~_empty(points) & (F.size(flagged(points, "is_malpractice_point")) == 0)


def _blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def case_errors() -> Column:
    """What keeps a case from being played; empty if it can be. Columns: case_id, case_name, against, decision_points, has_initial_state, has_legal_outcome, evidence_index."""
    c = F.col
    checks = (
        (_blank(c("case_id")), "Missing case_id"),
        (not_clinical(c("case_name"), c("against"), c("decision_points"), c("evidence_index")), "Non-clinical case"),
        (~c("has_initial_state"), "Missing initial_state"),
        (_empty(c("decision_points")), "No decision_points found"),
        (_no_point(c("decision_points")), "No malpractice point"),
        (~c("has_legal_outcome"), "Missing legal_outcome"),
        (_empty(c("evidence_index")), "Empty evidence_index"),
    )
    return F.array_compact(F.array(*[F.when(test, text) for test, text in checks]))


#: Words by which cases are filtered: fixed values.
BODY_STARTS = ("i)", "ii)", "iii)", "iv)", "(a)", "(b)")
GARBLED_STARTS = ("Note ", "The ", "Similar ", "I emphasise", "Mr Justice", "16.", "149.", "iii)", "iv)", "In Re ", "In the Matter")
GENERIC_NAME = "Medical malpractice case involving"
OTHER_FIELDS = (
    "barristers", "solicitors", "legal malpractice", "attorney", "condominium", "real estate", "mortgage", "property", "police",
    "employment", "labour", "labor", "termination", "dental admin", "insurance", "corp.", "corporation",
)
REGULATORY = (
    "v. fda", "v. kobach", "v. russo", "constitutional", "statute", "legislation", "licensing board", "regulation",
    "administrative", "certiorari", "writ of", "quo warranto", "june medical", "alliance hippocratic",
)
MEDICAL = (
    "hospital", "medical", "doctor", "patient", "surgery", "treatment", "diagnosis", "injury", "death", "negligence", "clinical",
    "healthcare", "nurse", "physician", "clinic", "health", "care", "therapy",
)


def filter_issues() -> Column:
    """Issues (code, critical) of a case. Columns: verdict, verdict_confirmed, case_name, decision_points, evidence_index, chief_complaint, history, clinical_domain."""
    c = F.col
    name, evidence = F.coalesce(c("case_name"), F.lit("")), c("evidence_index")
    starts = lambda signs: F.greatest(*[name.startswith(s).cast("int") for s in signs]) == 1
    texts = F.array_join(F.transform(evidence, lambda e: F.coalesce(e["text"], F.lit(""))), " ")
    bad_refs = F.size(F.filter(evidence, lambda e: F.coalesce(F.lower(e["paragraph_ref"]).isin("", "none", "null", "unknown"), F.lit(True))))
    other = _blank(c("clinical_domain")) | (c("clinical_domain") == "OTHER")
    n = F.coalesce(F.size(evidence), F.lit(0))
    name_issue = (
        F.when(name == "", "NO_NAME").when(F.length(name) > 200, "NAME_TOO_LONG").when(starts(BODY_STARTS), "NAME_IS_PARAGRAPH")
        .when(name.contains(GENERIC_NAME), "GENERIC_NAME").when(starts(GARBLED_STARTS), "GARBLED_NAME")
    )
    field = (
        F.when(other & mentions(name, OTHER_FIELDS) & ~mentions(name, MEDICAL), "NOT_MEDICAL")
        .when((c("clinical_domain") == "OTHER") & ~mentions(name, MEDICAL) & ~mentions(texts, MEDICAL), "NO_MEDICAL_CONTENT")
    )
    thin = (_blank(c("chief_complaint")) | (c("chief_complaint") == "Not documented in judgment")) & (F.coalesce(F.length("history"), F.lit(0)) < 20)
    found = F.array_compact(F.array(
        F.when(c("verdict").isNull() | (c("verdict") == "UNKNOWN"), "UNKNOWN_VERDICT"),
        name_issue,
        F.when(_empty(c("decision_points")), "NO_DECISIONS").when(_no_point(c("decision_points")), "NO_POINT"),
        F.when(n < 3, "LITTLE_EVIDENCE"),
        F.when(F.coalesce(bad_refs > n * 0.5, F.lit(False)), "BAD_REFERENCES"),
        F.when((c("verdict") != "UNKNOWN") & ~F.coalesce("verdict_confirmed", F.lit(True)), "VERDICT_NOT_CONFIRMED"),
        F.when(thin, "LITTLE_HISTORY"),
        F.when(mentions(name, REGULATORY) | mentions(texts, REGULATORY), "REGULATORY"),
        field,
    ))
    critical = ("UNKNOWN_VERDICT", "NO_DECISIONS", "NO_POINT", "VERDICT_NOT_CONFIRMED", "NOT_MEDICAL", "NO_MEDICAL_CONTENT", "GARBLED_NAME", "REGULATORY")
    return F.transform(found, lambda code: F.struct(code.alias("code"), code.isin(*critical).alias("critical")))


def passes(found: Column) -> Column:
    """Whether none of the issues is critical."""
    return ~F.exists(found, lambda i: i["critical"])
