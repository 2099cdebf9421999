"""Queries over nested cases, summaries of runs and simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import ladders as L
from assayer.operators import cases as C
from assayer.operators import qa as Q
from assayer.plans.tables import RUNS, read, runs


def _of(key, values):
    """One of some fixed values by a key."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _sql(key, values):
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][({key}) % {len(values)} + 1]"


RAW_PHASES = ("presentation", "workup", "decision", "procedure", "postop", "followup", "elsewhere", None)
RAW_NAMES = ("pre-operative", "Recovery", "DISCHARGE", "postop", "Workup", "anything", "perioperative")
RAW_ACTIONS = ("ORDER_TEST", "Diagnose", "surgery", "dance", None)
RAW_REQUESTS = ("LAB", "X-Ray", "biopsy", "referral", "music", None)
RAW_VERDICTS = ("SETTLED", "FOUND", "found", "PARTIAL", None)
RAW_FLAGS = ("Yes", "true", "0", "Found", " proven ", "not found", "not documented", "1", None)
RAW_LISTS = ("aspirin", "None known", "not documented in judgment", "unknown", "[\"a\",\"b\"]", None)
RAW_IDS = ("bailii-ewca-fca-1", "courtliste-9", "x-ONCA-2", "nzlii-fc-3", "austlii-4", "courtlistener-5", "bailii-6", "nzlii-7", "other")
RAW_MODELS = (
    "gpt-5.2-concise", "gpt-5.2", "gpt-4o-mini", "gpt-4o", "claude-sonnet-4.5", "claude-sonnet-4", "claude-3.5-haiku", "gemini-3-pro",
    "gemini-2.0-flash", "llama-4-maverick", "llama-4-scout", "qwen3-30b", "qwen-2.5-72b", "grok-4.1", "deepseek-r1", "mistral-large", "other",
)


def _points(spark, sf_dir):
    """Orders as cases with their lines as decision points, requests and evidence, in line order."""
    line = read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    item = F.struct(
        (F.col("l_linenumber") * 10_000_000 + k).alias("decision_id"),
        _of(k, RAW_PHASES).alias("available_phase"),
        (F.col("l_returnflag") == "R").alias("is_malpractice_point"),
        F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).otherwise("").alias("reasoning_error_type"),
        _of(k, ("A", "B", "C")).alias("endorsed"),
        _of(k, ("B", "C")).alias("defendant"),
        (k % 4).cast("double").alias("max_score"),
    )
    return line.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.sort_array(F.collect_list(item)).alias("points"))


def phase_availability(spark, sf_dir):
    now = F.element_at(F.array(*map(F.lit, C.PHASES)), (F.col("case_id") % 6 + 1).cast("int"))
    return _points(spark, sf_dir).select("case_id", F.size(C.available(F.col("points"), now)).alias("n_open"))


def nested_lookups(spark, sf_dir):
    bad = C.flagged(F.col("points"), "is_malpractice_point")
    return _points(spark, sf_dir).select(
        "case_id",
        F.size(bad).alias("n_bad"),
        F.size(C.having(F.col("points"), "endorsed", "B")).alias("n_b"),
        C.by_id(F.col("points"), "endorsed", "C")["defendant"].alias("of_c"),
        C.first_filled(bad, "reasoning_error_type", "none").alias("error_type"),
    )


def nested_paths(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.struct(F.struct(F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")).alias("inner")).alias("outer"))
    found = p.withColumns({"size": C.at_path(p, "outer.inner.size", 0), "lost": C.at_path(p, "outer.none.size", "?")})
    return C.shown(found, {"p_partkey": "part", "p_retailprice": "price", "size": "size", "lost": "lost"}, 1)


def event_domains(spark, sf_dir):
    """Distinct domains in order, and how many there are."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.countDistinct("user_id").alias("cases"))


def enum_maps(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", C.repaired_phase(_of(k, RAW_NAMES)).alias("phase"), C.repaired_action(_of(k, RAW_ACTIONS)).alias("action"),
        C.repaired_request(_of(k, RAW_REQUESTS)).alias("request"), C.repaired_verdict(_of(k, RAW_VERDICTS)).alias("verdict"),
    )


def coerced_values(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", L.coerced_bool(_of(k, RAW_FLAGS)).alias("strict"), L.coerced_bool(_of(k, RAW_FLAGS), False).alias("loose"),
        F.array_join(L.coerced_list(_of(k, RAW_LISTS)), "+").alias("listed"),
    )


def name_ladders(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        "p_partkey", L.jurisdiction(_of(k, RAW_IDS)).alias("jurisdiction"), L.summary_jurisdiction(_of(k, RAW_IDS)).alias("reduced"), L.model_name(_of(k, RAW_MODELS)).alias("model")
    )


def case_fallback(spark, sf_dir):
    """Lines as logs, of which the case is an even order or else one of two in three of all."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    second = orders.where("l_orderkey % 3 != 0").withColumn("o_orderpriority", F.lit("second"))
    return C.with_case(line, orders.where("l_orderkey % 2 = 0"), second, "l_orderkey", ["o_orderpriority"])


def orphan_responses(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    asked = read(spark, sf_dir, "orders").where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    met = C.with_request(line, asked, "l_orderkey")
    return met.groupBy("l_returnflag").agg(F.count("*").alias("responses"), F.sum(F.col("orphan").cast("long")).alias("errors"))


def reused_values(spark, sf_dir):
    """Lengths known for half of the documents, computed for the rest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 2 = 0").select("doc_id", F.lit(-1).alias("n"))
    return C.reused(docs, known, "doc_id", lambda d: d.select("doc_id", F.length("text").alias("n")))


def combined_texts(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("at"), F.when(F.col("l_tax") > 0.03, "").otherwise(F.col("l_returnflag")).alias("first"), F.when(F.col("l_discount") > 0.03, F.col("l_linestatus")).alias("second"))
    return C.combined_text(line, "l_orderkey", "at", ["first", "second"])


def simulations(spark, sf_dir):
    """Cases replayed with choices for the first of their points."""
    choices = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, (F.col("case_id") % 3).cast("int"))
    played = _points(spark, sf_dir).select("case_id", C.replayed(F.col("points"), choices).alias("results"))
    return played.select("case_id", *C.totals(F.col("results"))).withColumn("percentage", F.round("percentage", 4))


def _scored(spark, sf_dir):
    score = F.coalesce("primary_score", "score_0_2") / 2
    place = F.when(F.col("run_id") % 10 == 0, "Unknown").otherwise(F.col("jurisdiction"))
    return runs(spark, sf_dir).withColumns({"score": score, "place": place}).where("score IS NOT NULL")


_SCORED = RUNS + """, scored AS (SELECT *, coalesce(primary_score, score_0_2) / 2.0 AS score, CASE WHEN run_id % 10 = 0 THEN 'Unknown' ELSE jurisdiction END AS place
  FROM runs WHERE coalesce(primary_score, score_0_2) IS NOT NULL)"""


def known_jurisdictions(spark, sf_dir):
    known = _scored(spark, sf_dir).where("place IS NOT NULL AND lower(place) != 'unknown'")
    return known.groupBy("place").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def primary_statistics(spark, sf_dir):
    """By model with ten runs at least: means, zeros left out of those of costs and lengths."""
    above = lambda c: F.round(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), 4)
    rows = _scored(spark, sf_dir).groupBy("llm_name").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg((F.col("score") == 1).cast("double")) * 100, 6).alias("full_percent"),
        above("cost").alias("cost"), above("recommendation_length").alias("length"),
    )
    return rows.where("n >= 10")


def top_categories(spark, sf_dir):
    """The ten categories with the best means among those with five runs at least."""
    rows = _scored(spark, sf_dir).where("malpractice_type IS NOT NULL").groupBy("malpractice_type").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return rows.where("n >= 5").orderBy(F.desc("mean"), "malpractice_type").limit(10)


def agreement_counts(spark, sf_dir):
    same = (F.col("primary_score") == F.col("score_0_2")).cast("long")
    rows = runs(spark, sf_dir).where("primary_score IS NOT NULL AND score_0_2 IS NOT NULL").groupBy("llm_name").agg(F.count("*").alias("total"), F.sum(same).alias("agree"))
    return rows.withColumn("percent", F.round(100 * F.col("agree") / F.col("total"), 6))


def retest_concordance(spark, sf_dir):
    """Agreement and correlation of two scores of a run, over all and as shares of each pair of scores."""
    both = runs(spark, sf_dir).where("primary_score IS NOT NULL AND score_0_2 IS NOT NULL")
    cells = both.groupBy("score_0_2", "primary_score").agg(F.count("*").alias("n"))
    whole = both.agg(F.count("*").alias("all"), F.round(F.avg((F.col("score_0_2") == F.col("primary_score")).cast("double")), 6).alias("agreement"), F.round(F.corr("score_0_2", "primary_score"), 6).alias("r"))
    return cells.crossJoin(F.broadcast(whole)).select("score_0_2", "primary_score", "n", F.round(100 * F.col("n") / F.col("all"), 6).alias("percent"), "agreement", "r")  # one row of totals


def queue_status(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


def grade_distribution(spark, sf_dir):
    score = Q.suitability([((F.col("p_size") % 11) / 10.0, 0.3), ((F.col("p_partkey") % 11) / 10.0, 0.3), ((F.col("p_partkey") % 7) / 6.0, 0.2), ((F.col("p_size") % 5) / 4.0, 0.2)])
    graded = read(spark, sf_dir, "part").select(F.round(score, 6).alias("score")).withColumn("grade", Q.grade(F.col("score")))
    good = Q.at_least(graded, "grade", "good").count()
    return graded.groupBy("grade").agg(F.count("*").alias("n")).withColumn("usable", F.lit(good).cast("long"))


def outlier_counts(spark, sf_dir):
    p = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(p > 20000).alias("above_20k"), F.count_if(p > 5000).alias("above_5k"))


def ratio_to_max(spark, sf_dir):
    rows = _scored(spark, sf_dir).groupBy("llm_name").agg(F.avg("recommendation_length").alias("length"))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("length").alias("most")))).select("llm_name", F.round(F.col("most") / F.col("length"), 6).alias("ratio"))  # one row


def correlations_wide(spark, sf_dir):
    """Pearson of score and each metric by model, for more than ten runs, a column for each metric."""
    s = _scored(spark, sf_dir)
    long = s.select("llm_name", "score", F.explode(F.create_map(F.lit("cost"), F.col("cost"), F.lit("length"), F.col("recommendation_length").cast("double"))).alias("metric", "value"))
    r = long.where("value IS NOT NULL").groupBy("llm_name", "metric").agg(F.count("*").alias("n"), F.round(F.corr("score", "value"), 6).alias("r")).where("n > 10")
    return r.groupBy("llm_name").pivot("metric", ["cost", "length"]).agg(F.first("r"))


def evolved_replies(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    reply = C.evolved_reply(F.col("text"), F.when(F.col("conv_id") % 2 == 0, "worsening").otherwise("stable"), F.col("turn") * 30)
    return c.groupBy("role").agg(F.count(reply).alias("replies"), F.count("*").alias("turns"))


CONDUCT_TEXTS = ("They reassure without tests", "Omit the scan, no need for it", "Explain all risks", None)


def conduct_matches(spark, sf_dir):
    k = F.col("p_partkey")
    found = C.resembles_conduct(_of(k, CONDUCT_TEXTS), F.array(_of(k + 1, CONDUCT_TEXTS), _of(k, CONDUCT_TEXTS)), k % 7, k % 5)
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("matches"))


CASE_NAMES = ("Smith v Jones", "Doe v City Pharmacy", "The matter of X", "Roe v. FDA", "(a) something", "Poe v Acme Insurance", "Lee v General Hospital", None)
EVIDENCE_TEXTS = ("The patient was seen", "He was arrested at night", "A contract of employment", "Nothing to see")


def _cases(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    point = F.struct((k % 3 == 0).alias("is_malpractice_point"), F.when(k % 11 == 0, "Dispensing at a pharmacy").alias("clinical_context"), F.lit("What now?").alias("prompt"))
    evidence = F.struct(_of(k, EVIDENCE_TEXTS).alias("text"), F.when(k % 4 == 0, "None").otherwise("12").alias("paragraph_ref"))
    return p.select(
        F.when(k % 13 != 0, k.cast("string")).alias("case_id"), k.alias("part"), _of(k, CASE_NAMES).alias("case_name"), F.array(_of(k, ("Dr A", "The Bank", "B Ltd"))).alias("against"),
        F.when(k % 5 != 0, F.array(point)).alias("decision_points"), (k % 6 != 0).alias("has_initial_state"), (k % 7 != 0).alias("has_legal_outcome"),
        F.when(k % 9 != 0, F.array_repeat(evidence, (k % 4 + 1).cast("int"))).alias("evidence_index"),
        _of(k, ("SETTLED", "UNKNOWN", None, "NO_LIABILITY")).alias("verdict"), (k % 10 != 0).alias("verdict_confirmed"),
        _of(k, ("Pain", "Not documented in judgment", "")).alias("chief_complaint"), F.when(k % 2 == 0, "A history of more than twenty letters").alias("history"),
        _of(k, ("OTHER", "SURGERY", None)).alias("clinical_domain"),
    )


def case_validity(spark, sf_dir):
    return _cases(spark, sf_dir).select("part", F.array_join(C.case_errors(), ";").alias("errors"))


def case_filter(spark, sf_dir):
    found = C.filter_issues()
    return _cases(spark, sf_dir).select("part", F.array_join(F.transform(found, lambda i: i["code"]), ";").alias("issues"), C.passes(found).alias("passes"))


QUERIES = {f.__name__: f for f in (
    phase_availability, nested_lookups, nested_paths, event_domains, enum_maps, coerced_values, name_ladders, case_fallback, orphan_responses,
    reused_values, combined_texts, simulations, known_jurisdictions, primary_statistics, top_categories, agreement_counts, retest_concordance,
    queue_status, grade_distribution, outlier_counts, ratio_to_max, correlations_wide, evolved_replies, conduct_matches, case_validity, case_filter,
)}

_LINES = "SELECT l_orderkey AS case_id, l_linenumber * 10000000 + l_partkey AS n, l_partkey AS k, l_returnflag = 'R' AS bad, CASE WHEN l_tax > 0.02 THEN l_linestatus ELSE '' END AS e FROM lineitem"
_HAS = lambda text, words: "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"
_CASES = f"""cases AS (SELECT p_partkey AS part, p_partkey AS k, CASE WHEN p_partkey % 13 <> 0 THEN 'x' END AS case_id, coalesce({_sql('p_partkey', CASE_NAMES)}, '') AS name,
  {_sql('p_partkey', EVIDENCE_TEXTS)} AS t, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 4 + 1 ELSE 0 END AS n, {_sql('p_partkey', ('SETTLED', 'UNKNOWN', None, 'NO_LIABILITY'))} AS verdict,
  {_sql('p_partkey', ('Pain', 'Not documented in judgment', ''))} AS complaint, {_sql('p_partkey', ('OTHER', 'SURGERY', None))} AS field FROM part)"""

ORACLES = {
    "phase_availability": f"""SELECT case_id, count(*) FILTER (k % 8 > 5 OR k % 8 <= case_id % 6)::INT AS n_open FROM ({_LINES}) GROUP BY 1""",
    "nested_lookups": f"""SELECT case_id, count(*) FILTER (bad)::INT AS n_bad, count(*) FILTER (k % 3 = 1)::INT AS n_b, arg_min(['B', 'C'][k % 2 + 1], n) FILTER (k % 3 = 2) AS of_c,
  coalesce(arg_min(e, n) FILTER (bad AND e <> ''), 'none') AS error_type FROM ({_LINES}) GROUP BY 1""",
    "nested_paths": "SELECT p_partkey AS part, round(p_retailprice, 1) AS price, CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS size, '?' AS lost FROM part",
    "event_domains": "SELECT event_type AS domain, count(DISTINCT user_id) AS cases FROM events GROUP BY 1",
    "enum_maps": """SELECT p_partkey, ['workup', 'postop', 'followup', 'postop', 'Workup', 'decision', 'procedure'][p_partkey % 7 + 1] AS phase,
  ['ORDER_TEST', 'ORDER_TEST', 'SELECT_TECHNIQUE', 'CHOOSE_MANAGEMENT', 'CHOOSE_MANAGEMENT'][p_partkey % 5 + 1] AS action,
  ['LAB', 'IMAGING', 'PATHOLOGY', 'CONSULT_NOTE', 'CONSULT_NOTE', 'LAB'][p_partkey % 6 + 1] AS request,
  ['SETTLED', 'LIABILITY_FOUND', 'UNKNOWN', 'PARTIAL_LIABILITY', 'UNKNOWN'][p_partkey % 5 + 1] AS verdict FROM part""",
    "coerced_values": """SELECT p_partkey, [true, true, false, NULL, NULL, NULL, NULL, true, NULL][p_partkey % 9 + 1] AS strict,
  [true, true, false, true, true, false, false, true, false][p_partkey % 9 + 1] AS loose, ['aspirin', '', '', '', 'a+b', NULL][p_partkey % 6 + 1] AS listed FROM part""",
    "name_ladders": """SELECT p_partkey, ['CA', 'US', 'CA', 'CA', 'AU', 'US', 'UK', 'NZ', NULL][p_partkey % 9 + 1] AS jurisdiction,
  ['UK', 'Unknown', 'Unknown', 'NZ', 'Unknown', 'US', 'UK', 'NZ', 'Unknown'][p_partkey % 9 + 1] AS reduced,
  ['GPT-5.2-Concise', 'GPT-5.2', 'GPT-4o Mini', 'GPT-4o', 'Claude Sonnet 4.5', 'Claude Sonnet 4', 'Claude 3.5 Haiku', 'Gemini 3 Pro', 'Gemini 2.0 Flash', 'Llama 4 Maverick',
   'Llama 4 Scout', 'Qwen3 30B', 'Qwen 2.5 72B', 'Grok 4.1', 'DeepSeek R1', 'Mistral Large', 'other'][p_partkey % 17 + 1] AS model FROM part""",
    "case_fallback": """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN o_orderpriority ELSE 'second' END AS o_orderpriority
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 <> 0""",
    "orphan_responses": """SELECT l_returnflag, count(*) AS responses, count(*) FILTER (o_orderkey IS NULL) AS errors
  FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = l_orderkey GROUP BY 1""",
    "reused_values": "SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN -1 ELSE length(text) END)::INT AS n FROM documents",
    "combined_texts": """SELECT l_orderkey, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY l_at, t) AS text FROM (
  SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS l_at, CASE WHEN l_tax > 0.03 THEN CASE WHEN l_discount > 0.03 THEN l_linestatus END ELSE l_returnflag END AS t FROM lineitem) WHERE t IS NOT NULL GROUP BY 1""",
    "simulations": f"""WITH p AS (SELECT case_id, (k % 4)::DOUBLE AS m, ['A', 'B', 'C'][k % 3 + 1] AS e, ['B', 'C'][k % 2 + 1] AS d,
    row_number() OVER (PARTITION BY case_id ORDER BY n) AS i FROM ({_LINES})),
  c AS (SELECT *, CASE WHEN i <= case_id % 3 THEN ['A', 'B', 'C'][i] ELSE e END AS chosen FROM p)
SELECT case_id, sum(CASE WHEN chosen = e THEN m ELSE 0 END)::DOUBLE AS total_score, sum(m)::DOUBLE AS max_score,
  round(CASE WHEN sum(m) > 0 THEN sum(CASE WHEN chosen = e THEN m ELSE 0 END) / sum(m) * 100 ELSE 0.0 END, 4)::DOUBLE AS percentage, count(*)::INT AS decisions,
  count(*) FILTER (chosen = e)::INT AS court_matches, count(*) FILTER (chosen = d)::INT AS defendant_matches FROM c GROUP BY 1""",
    "known_jurisdictions": f"WITH {_SCORED} SELECT place, count(*) AS n, round(avg(score), 6) AS mean FROM scored WHERE lower(place) <> 'unknown' GROUP BY 1",
    "primary_statistics": f"""WITH {_SCORED} SELECT llm_name, count(*) AS n, round(avg(score), 6) AS mean, round(avg((score = 1)::INT) * 100, 6) AS full_percent,
  round(coalesce(avg(cost) FILTER (cost > 0), 0.0), 4) AS cost, round(coalesce(avg(recommendation_length) FILTER (recommendation_length > 0), 0.0), 4) AS length
  FROM scored GROUP BY 1 HAVING count(*) >= 10""",
    "top_categories": f"""WITH {_SCORED} SELECT malpractice_type, count(*) AS n, round(avg(score), 6) AS mean FROM scored WHERE malpractice_type IS NOT NULL GROUP BY 1 HAVING count(*) >= 5
  ORDER BY mean DESC, malpractice_type LIMIT 10""",
    "agreement_counts": f"""WITH {RUNS} SELECT llm_name, count(*) AS total, count(*) FILTER (primary_score = score_0_2) AS agree,
  round(100.0 * count(*) FILTER (primary_score = score_0_2) / count(*), 6)::DOUBLE AS percent FROM runs WHERE primary_score IS NOT NULL AND score_0_2 IS NOT NULL GROUP BY 1""",
    "retest_concordance": f"""WITH {RUNS}, b AS (SELECT * FROM runs WHERE primary_score IS NOT NULL AND score_0_2 IS NOT NULL),
  w AS (SELECT count(*) AS n_all, round(avg((score_0_2 = primary_score)::INT), 6) AS agreement, round(corr(score_0_2, primary_score), 6) AS r FROM b)
SELECT score_0_2, primary_score, count(*) AS n, round(100.0 * count(*) / any_value(n_all), 6)::DOUBLE AS percent, any_value(agreement) AS agreement, any_value(r) AS r FROM b, w GROUP BY 1, 2""",
    "queue_status": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "grade_distribution": """WITH s AS (SELECT round((p_size % 11) / 10.0::DOUBLE * 0.3::DOUBLE + (p_partkey % 11) / 10.0::DOUBLE * 0.3::DOUBLE + (p_partkey % 7) / 6.0::DOUBLE * 0.2::DOUBLE + (p_size % 5) / 4.0::DOUBLE * 0.2::DOUBLE, 6) AS score FROM part),
  g AS (SELECT CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.65 THEN 'good' WHEN score >= 0.5 THEN 'marginal' WHEN score >= 0.35 THEN 'poor' ELSE 'unsuitable' END AS grade FROM s)
SELECT grade, count(*) AS n, (SELECT count(*) FROM g WHERE grade IN ('excellent', 'good')) AS usable FROM g GROUP BY 1""",
    "outlier_counts": "SELECT l_returnflag, count(*) FILTER (l_extendedprice > 20000) AS above_20k, count(*) FILTER (l_extendedprice > 5000) AS above_5k FROM lineitem GROUP BY 1",
    "ratio_to_max": f"WITH {_SCORED}, m AS (SELECT llm_name, avg(recommendation_length) AS v FROM scored GROUP BY 1) SELECT llm_name, round((SELECT max(v) FROM m) / v, 6) AS ratio FROM m",
    "correlations_wide": f"""WITH {_SCORED} SELECT llm_name, CASE WHEN count(cost) > 10 THEN round(corr(score, cost), 6) END AS cost,
  CASE WHEN count(recommendation_length) > 10 THEN round(corr(score, recommendation_length), 6) END AS length FROM scored GROUP BY 1 HAVING count(*) > 10""",
    "evolved_replies": f"""SELECT role, count(*) FILTER (conv_id % 2 = 0 AND turn * 30 > 60 AND {_HAS('text', ('pain', 'feel', 'symptom', 'worse', 'better', 'how are you'))}) AS replies, count(*) AS turns
  FROM conversations GROUP BY 1""",
    "conduct_matches": """SELECT p_partkey, p_partkey % 4 IN (0, 1) AND NOT (p_partkey % 5 > 0 AND (p_partkey % 7) / nullif(p_partkey % 5, 0)::DOUBLE >= 0.5) IS TRUE AS matches FROM part""",
    "case_validity": f"""WITH {_CASES} SELECT part, concat_ws(';', CASE WHEN case_id IS NULL THEN 'Missing case_id' END,
  CASE WHEN contains(lower(name), 'pharmacy') OR k % 3 = 1 OR (k % 5 <> 0 AND k % 11 = 0) OR (n > 0 AND k % 4 IN (1, 2)) THEN 'Non-clinical case' END,
  CASE WHEN k % 6 = 0 THEN 'Missing initial_state' END, CASE WHEN k % 5 = 0 THEN 'No decision_points found' END, CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN 'No malpractice point' END,
  CASE WHEN k % 7 = 0 THEN 'Missing legal_outcome' END, CASE WHEN n = 0 THEN 'Empty evidence_index' END) AS errors FROM cases""",
    "case_filter": f"""WITH {_CASES}, i AS (SELECT part, [CASE WHEN verdict IS NULL OR verdict = 'UNKNOWN' THEN 'UNKNOWN_VERDICT' END,
  CASE WHEN name = '' THEN 'NO_NAME' WHEN starts_with(name, '(a)') THEN 'NAME_IS_PARAGRAPH' WHEN starts_with(name, 'The ') THEN 'GARBLED_NAME' END,
  CASE WHEN k % 5 = 0 THEN 'NO_DECISIONS' WHEN k % 3 <> 0 THEN 'NO_POINT' END, CASE WHEN n < 3 THEN 'LITTLE_EVIDENCE' END, CASE WHEN k % 4 = 0 AND n > 0 THEN 'BAD_REFERENCES' END,
  CASE WHEN verdict <> 'UNKNOWN' AND k % 10 = 0 THEN 'VERDICT_NOT_CONFIRMED' END, CASE WHEN complaint <> 'Pain' AND k % 2 <> 0 THEN 'LITTLE_HISTORY' END,
  CASE WHEN contains(lower(name), 'v. fda') THEN 'REGULATORY' END,
  CASE WHEN (field IS NULL OR field = 'OTHER') AND contains(lower(name), 'insurance') THEN 'NOT_MEDICAL'
    WHEN field = 'OTHER' AND NOT contains(lower(name), 'hospital') AND NOT (n > 0 AND contains(t, 'patient')) THEN 'NO_MEDICAL_CONTENT' END] AS found FROM cases)
SELECT part, array_to_string(list_filter(found, lambda x: x IS NOT NULL), ';') AS issues,
  len(list_filter(found, lambda x: x IN ('UNKNOWN_VERDICT', 'NO_DECISIONS', 'NO_POINT', 'VERDICT_NOT_CONFIRMED', 'NOT_MEDICAL', 'NO_MEDICAL_CONTENT', 'GARBLED_NAME', 'REGULATORY'))) = 0 AS passes FROM i""",
}
