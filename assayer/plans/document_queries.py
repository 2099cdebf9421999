"""Queries over documents, sessions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import documents as D
from assayer.operators import grounding as R
from assayer.operators import qa as Q
from assayer.operators import scoring as S
from assayer.plans.tables import ratings, read, RATINGS
from assayer.streaming import sessions as E


def text_paragraphs(spark, sf_dir):
    return D.text_paragraphs(read(spark, sf_dir, "documents"), "doc_id", "text", r"\n")


def page_paragraphs(spark, sf_dir):
    return D.html_paragraphs(read(spark, sf_dir, "pages"), "page_id", "html")


def paragraph_sections(spark, sf_dir):
    rows = D.with_sections(text_paragraphs(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id").agg(F.sum(F.col("is_heading").cast("long")).alias("headings"), F.countDistinct("section").alias("sections"))


def paragraph_numbers(spark, sf_dir):
    """Titles with their leading number taken off."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(". "), F.col("p_name")).alias("t"))
    number, rest = D.numbered(F.col("t"))
    return p.select("p_partkey", number.alias("number"), rest.alias("rest"))


def token_segments(spark, sf_dir):
    rows = text_paragraphs(spark, sf_dir).withColumn("tokens", F.ceil(F.length("text") / 4).cast("int"))
    return D.segments(rows, "doc_id", "pos", "tokens", 400, 60)


def evidence_context(spark, sf_dir):
    rows = text_paragraphs(spark, sf_dir).withColumn("tokens", F.ceil(F.length("text") / 4).cast("int"))
    return D.evidence_context(rows, "doc_id", "pos", "text", "tokens", ["licen", "token"], 800)


def evidence_ids(spark, sf_dir):
    rows = D.with_evidence_ids(text_paragraphs(spark, sf_dir), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("evidence_id").alias("last_id"), F.sum(F.length("excerpt")).alias("chars"))


def segment_merge(spark, sf_dir):
    """Line items as extracts of an order, merged in line order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("k"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("first_flag"), F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")).alias("last_status"))
    out = D.merged_segments(line.withColumn("flags", F.array("first_flag")), "l_orderkey", "k", ["first_flag"], ["last_status"], ["flags"])
    return out.select("l_orderkey", "first_flag", "last_status", F.array_join("flags", ",").alias("flags"))


def session_clock(spark, sf_dir):
    """Users as sessions: a purchase orders imaging, a click a test, an error is an urgent start."""
    kind = F.when(F.col("event_type") == "purchase", "imaging").when(F.col("event_type") == "click", "test").when(F.col("event_type") == "error", "start_urgent").otherwise("message")
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "event_id", kind.alias("kind"), F.col("ts").alias("at"))
    return E.replay(events)


def final_turns(spark, sf_dir):
    return E.final_turns(read(spark, sf_dir, "conversations"), ["The ", "the "])


def event_windows(spark, sf_dir):
    return E.windowed(read(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day")


def sliding_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")


def checklist_scores(spark, sf_dir):
    """Orders as checklists: each line is an item with its quantity as weight, met unless returned, primary if it is the first."""
    line = read(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_quantity").alias("weight"), (F.col("l_returnflag") != "R").alias("met"), (F.col("l_linenumber") == 1).alias("is_primary"))
    rows = line.groupBy("l_orderkey").agg(F.collect_list(item).alias("scored"))
    ratio = S.weighted_ratio(F.col("scored"))
    scores = rows.select(F.round(ratio, 6).alias("ratio"), S.composite_score(ratio, F.lit(0.5)).alias("composite"), S.primary_score(F.col("scored"), F.lit(False)).alias("primary"))
    return scores.groupBy("composite", "primary").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 2).alias("ratios"))


def rank_changes(spark, sf_dir):
    means = ratings(spark, sf_dir).groupBy("llm_name").agg(F.round(F.avg("human"), 6).alias("old"), F.round(F.avg("gpt5"), 6).alias("new"))
    return S.rank_changes(means, "llm_name", "old", "new")


def option_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("score", S.option_score(F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") % 10, F.col("o_totalprice") > 20000))
    return o.groupBy("score").agg(F.count("*").alias("n"))


def verdict_tail(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", Q.verdict_in_tail(F.col("text"), "the|der", "le|el").alias("verdict"))
    return d.groupBy("lang", "verdict").agg(F.count("*").alias("n"))


def evidence_grounding(spark, sf_dir):
    """Benchmark items against themselves with a part cut off."""
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", Q.grounded(F.col("text"), F.substring("text", 1, 60), ["other", "about"]).alias("grounded"))


def evidence_in_next(spark, sf_dir):
    """Every paragraph of every document, with its number, held against the whole text of the next document."""
    docs = read(spark, sf_dir, "documents")
    rows = text_paragraphs(spark, sf_dir).select("doc_id", F.col("pos").cast("string").alias("ref"), "pos", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("source"))
    out = R.grounded(rows, following, "doc_id", "pos", "text", "ref", "source", ["other", "about"])
    return out.select("doc_id", "pos", "ref_found", F.col("n_words").cast("long").alias("n_words"), "n_found", "grounded")


def criteria_met(spark, sf_dir):
    """User turns as criteria and the assistant turns after them as responses."""
    c = read(spark, sf_dir, "conversations")
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("criterion")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")), ["conv_id", "turn"])
    met = S.criterion_met(F.col("criterion"), F.col("response"), ["reasoning"], ["because", "risk", "unless"], ["with", "that"])
    return pairs.select("conv_id", "turn", met.alias("met"))


def quarantine_reasons(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    reason = Q.quarantine_reason(F.col("n_chars") > 100, F.upper("lang"), F.lit(None).cast("boolean"), F.col("text"), ["ES"], ["idiot", "licen[sc]ed"])
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    text_paragraphs, page_paragraphs, paragraph_sections, paragraph_numbers, token_segments, evidence_context, evidence_ids, segment_merge,
    session_clock, final_turns, event_windows, sliding_windows, checklist_scores, rank_changes, option_scores, verdict_tail, evidence_grounding, evidence_in_next,
    criteria_met, quarantine_reasons,
)}

_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), p AS (SELECT doc_id, pos::INT AS pos, trim(text) AS text FROM l WHERE trim(text) <> '')"
_SPLIT_WORDS = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_ROWS = "r AS (SELECT doc_id, pos, text, ceil(length(text) / 4)::INT AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM p)"
_TAIL = "list_filter(cur, lambda x, k: list_sum([y.t FOR y IN cur[k:]]) <= 60)"
ORACLES = {
    "evidence_in_next": f"""WITH {_LINES},
e AS (SELECT p.doc_id, pos, pos::VARCHAR AS ref, coalesce(n.text, '') AS s,
        list_filter(regexp_split_to_array(lower(p.text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{5,}}') AND w NOT IN ('other', 'about'))[1:5] AS words
      FROM p LEFT JOIN documents n ON n.doc_id = p.doc_id + 1),
f AS (SELECT *, regexp_matches(s, '(?mi)\\[' || ref || '\\]|^' || ref || '\\.|¶\\s*' || ref || '|para(?:graph)?\\s*' || ref) AS ref_found,
        len(list_filter(words, lambda w: contains(lower(s), w))) AS n_found FROM e)
SELECT doc_id, pos, ref_found, len(words) AS n_words, n_found, ref_found OR len(words) = 0 OR n_found >= len(words) * 0.5 AS grounded FROM f""",
    "token_segments": f"""WITH RECURSIVE {_LINES}, {_ROWS},
w AS (
  SELECT doc_id, i, [{{'p': pos, 't': tokens}}] AS cur, false AS carried, 0 AS seg, NULL::STRUCT(seg INT, a INT, b INT, n INT, o BOOLEAN) AS closed FROM r WHERE i = 1
  UNION ALL
  SELECT doc_id, i, list_append(CASE WHEN full_ THEN tail ELSE cur END, {{'p': pos, 't': tokens}}), CASE WHEN full_ THEN len(tail) > 0 ELSE carried END, seg + full_::INT,
         CASE WHEN full_ THEN {{'seg': seg, 'a': cur[1].p, 'b': cur[-1].p, 'n': total, 'o': carried}} END
  FROM (SELECT *, CASE WHEN coalesce(list_sum([x.t FOR x IN fits]), 0) + tokens > 400 THEN [] ELSE fits END AS tail FROM (
    SELECT w.doc_id, r.i, r.pos, r.tokens, cur, carried, seg, list_sum([x.t FOR x IN cur])::INT AS total, list_sum([x.t FOR x IN cur]) + r.tokens > 400 AS full_, {_TAIL} AS fits
    FROM w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i + 1))),
f AS (SELECT doc_id, closed FROM w WHERE closed IS NOT NULL
  UNION ALL SELECT w.doc_id, {{'seg': seg, 'a': cur[1].p, 'b': cur[-1].p, 'n': list_sum([x.t FOR x IN cur])::INT, 'o': carried}} FROM w JOIN r ON r.doc_id = w.doc_id AND r.i = w.i AND r.i = r.n)
SELECT doc_id, closed.seg AS segment_id, closed.a AS first_pos, closed.b AS last_pos, closed.n AS n_tokens, closed.o AS overlaps FROM f""",
    "evidence_context": f"""WITH RECURSIVE {_LINES}, {_ROWS},
h AS (SELECT *, contains(lower(text), 'licen') OR contains(lower(text), 'token') AS hit FROM r),
-- in the order of the kinds: the last twenty from the end, then all rows for each other kind
q AS (
  SELECT doc_id, 1 AS kind, pos, tokens, i, n - i AS o FROM h WHERE i > n - 20 UNION ALL SELECT doc_id, 2, pos, tokens, i, i FROM h WHERE hit
  UNION ALL SELECT doc_id, 3, pos, tokens, i, i FROM h WHERE i <= 15 UNION ALL SELECT doc_id, 4, pos, tokens, i, i FROM h),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, o) AS step FROM q),
w AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS step, 0 AS kind, NULL::INT AS pos, [240, 200, 200, 120]::INT[] AS room, []::BIGINT[] AS taken, false AS fits FROM s
  UNION ALL
  SELECT doc_id, step, kind, pos, CASE WHEN fits THEN list_transform(room, lambda x, k: CASE WHEN k = kind THEN x - tokens ELSE x END) ELSE room END,
         CASE WHEN fits THEN list_append(taken, i) ELSE taken END, fits
  FROM (SELECT w.doc_id, s.step, s.kind, s.pos, s.tokens, s.i, room, taken, s.tokens <= room[s.kind] AND NOT list_contains(taken, s.i) AS fits FROM w JOIN s ON s.doc_id = w.doc_id AND s.step = w.step + 1))
SELECT doc_id, pos, ['last', 'term', 'first', 'middle'][kind] AS reason FROM w WHERE fits""",
    "text_paragraphs": f"WITH {_LINES} SELECT doc_id, pos, text FROM p",
    "evidence_ids": f"""WITH {_LINES}, r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM p)
SELECT doc_id, max('E' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END) AS last_id, sum(least(length(text), 500))::BIGINT AS chars FROM r GROUP BY 1""",
    "paragraph_numbers": "SELECT p_partkey, p_size::VARCHAR AS number, p_name AS rest FROM part",
    "segment_merge": """WITH r AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS k, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS f, CASE WHEN l_discount > 0.02 THEN l_linestatus END AS s FROM lineitem),
d AS (SELECT l_orderkey, f, min(k) AS k FROM r WHERE f IS NOT NULL GROUP BY ALL)
SELECT l_orderkey, arg_min(f, k) FILTER (f IS NOT NULL) AS first_flag, arg_max(s, k) FILTER (s IS NOT NULL) AS last_status,
       coalesce((SELECT string_agg(f, ',' ORDER BY k) FROM d WHERE d.l_orderkey = r.l_orderkey), '') AS flags FROM r GROUP BY l_orderkey""",
    "session_clock": """WITH e AS (SELECT user_id::VARCHAR AS session_id, event_id, count(*) OVER w * 15 AS elapsed, count(*) FILTER (event_type IN ('purchase', 'click')) OVER w AS t,
  count(*) FILTER (event_type = 'purchase') OVER w AS i, count(*) FILTER (event_type = 'error') OVER w AS u FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT session_id, event_id, elapsed::INT AS elapsed, CASE WHEN u > 0 AND elapsed > 120 AND i = 0 THEN 'worsening' WHEN t > 0 THEN 'stable' ELSE 'unknown' END AS trajectory FROM e""",
    "final_turns": """WITH f AS (SELECT conv_id, min(turn) FILTER (turn >= 3 AND (contains(text, 'The ') OR contains(text, 'the '))) AS h, least(max(turn), 10) AS l FROM conversations GROUP BY 1)
SELECT conv_id, coalesce(h, l) AS final_turn, h IS NULL AS forced FROM f""",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_windows": """SELECT (date_trunc('day', ts) - INTERVAL (k) DAY)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""",
    "checklist_scores": """WITH r AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag <> 'R') AS m, sum(l_quantity) AS t, bool_and(l_returnflag <> 'R') FILTER (l_linenumber = 1) AS p,
  coalesce(sum(l_quantity) FILTER (l_linenumber <> 1 AND l_returnflag <> 'R'), 0) AS rm, sum(l_quantity) FILTER (l_linenumber <> 1) AS rt FROM lineitem GROUP BY 1),
s AS (SELECT round(coalesce(m, 0) / t, 6) AS ratio, 0.9::DOUBLE * (coalesce(m, 0) / t) + 0.1::DOUBLE * 0.5::DOUBLE AS c, coalesce(p, true) AS p, coalesce(rm / rt, 1.0) AS q FROM r)
SELECT CASE WHEN c < 0.25 THEN 0 WHEN c < 0.5 THEN 1 ELSE 2 END AS composite, CASE WHEN NOT p THEN 0 WHEN q < 0.5 THEN 1 ELSE 2 END AS primary, count(*) AS n, round(sum(ratio), 2) AS ratios FROM s GROUP BY ALL""",
    "rank_changes": f"""WITH {RATINGS}, m AS (SELECT llm_name, round(avg(human), 6) AS o, round(avg(gpt5), 6) AS n FROM ratings GROUP BY 1),
r AS (SELECT llm_name, row_number() OVER (ORDER BY o DESC, llm_name) AS old_rank, row_number() OVER (ORDER BY n DESC, llm_name) AS new_rank FROM m)
SELECT llm_name, old_rank::INT AS old_rank, new_rank::INT AS new_rank, (old_rank - new_rank)::INT AS change FROM r""",
    "option_scores": """SELECT CASE WHEN o_totalprice <= 20000 THEN 0 WHEN o_orderstatus = 'F' THEN o_orderkey % 10 WHEN o_orderpriority = '1-URGENT' THEN floor((o_orderkey % 10) / 4) ELSE floor((o_orderkey % 10) / 2) END::BIGINT AS score,
       count(*) AS n FROM orders GROUP BY 1""",
    "verdict_tail": """WITH t AS (SELECT lang, lower(substr(text, floor(length(text) * (1 - 0.3::DOUBLE))::INT + 1)) AS t FROM documents),
c AS (SELECT lang, len(regexp_extract_all(t, 'the|der')) AS y, len(regexp_extract_all(t, 'le|el')) AS n FROM t)
SELECT lang, CASE WHEN y > n THEN 'LIABLE' WHEN n > y THEN 'NOT_LIABLE' ELSE 'UNCLEAR' END AS verdict, count(*) AS n FROM c GROUP BY ALL""",
    "criteria_met": f"""WITH p AS (SELECT u.conv_id, u.turn, u.text AS criterion, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
w AS (SELECT *, list_distinct(list_filter({_SPLIT_WORDS.format("regexp_replace(criterion, '[^A-Za-z0-9 \\t\\n\\r]', ' ', 'g')")}, lambda x: length(x) >= 4 AND x NOT IN ('with', 'that'))) AS own FROM p)
SELECT conv_id, turn, CASE WHEN contains(lower(criterion), 'reasoning') THEN contains(lower(response), 'because')::INT + contains(lower(response), 'risk')::INT + contains(lower(response), 'unless')::INT >= 3
  WHEN len(own) > 0 THEN len(list_filter(own, lambda x: contains(lower(response), x))) / len(own) >= 0.4 ELSE false END AS met FROM w""",
    "quarantine_reasons": """SELECT CASE WHEN n_chars <= 100 THEN 'untestable' WHEN lang = 'es' THEN 'verdict:ES' WHEN regexp_matches(text, '(?i)idiot|licen[sc]ed') THEN 'evidence' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
}
