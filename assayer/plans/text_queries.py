"""Queries over texts, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as T
from assayer.functions.rules import Rules
from assayer.plans.tables import read

TERMS = ("the ", "und ", "pour", "ción")
LABELS = (("english", ("the ", "and ", "of ")), ("german", ("der ", "und ", "die ")), ("french", ("les ", "pour ", "que ")))
RULES = Rules((("licen[sc]e", "legal"), (r"@\w+", "contact"), ("token|key", "secret"), (r"\bidiot\b", "rude")), "plain", ("rude", "secret"))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def sentence_stats(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))


def lexical_overlap(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", (T.adjacent_overlap(F.col("text")) + 0.0).alias("adjacent"), (T.global_overlap(F.col("text")) + 0.0).alias("overall"))


def pronoun_density(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.pronoun_density(F.col("text")).alias("per_hundred"))


def readability(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.grade_level(F.col("text")).alias("grade"), T.smog_index(F.col("text")).alias("smog"))


def keyword_flags(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.mentions(t, TERMS).alias("any_term"), T.terms_present(t, TERMS).alias("n_terms"), T.occurrences(t, "[0-9]+").alias("numbers"))


def domain_argmax(spark, sf_dir):
    best = T.best_label(F.col("text"), LABELS)
    return _docs(spark, sf_dir).groupBy("lang", best.alias("label")).agg(F.count("*").alias("n"))


def multi_labels(spark, sf_dir):
    found = F.array_join(T.all_labels(F.col("text"), LABELS, "none"), ",")
    return _docs(spark, sf_dir).groupBy(found.alias("labels")).agg(F.count("*").alias("n"))


def rule_classifier(spark, sf_dir):
    t = F.col("text")
    d = _docs(spark, sf_dir).select(RULES.first(t).alias("first"), RULES.prioritized(t).alias("prioritized"), F.array_join(RULES.matches(t), ",").alias("matches"))
    return d.groupBy("first", "prioritized", "matches").agg(F.count("*").alias("n"))


def url_normalize(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.normalized_url(F.col("url")).alias("url"))


def content_hash_dupes(spark, sf_dir):
    same = _docs(spark, sf_dir).groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("copies"))
    return same.groupBy("copies").agg(F.count("*").alias("texts"))


def redacted_texts(spark, sf_dir):
    t = T.without_terms(F.col("text"), ("the", "and", "idiot"))
    return _docs(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def questions_before_final(spark, sf_dir):
    """User turns before the first turn of a chat that holds a marker; null if there are none."""
    c = read(spark, sf_dir, "conversations")
    marks = c.where(F.col("text").contains("The ")).groupBy("conv_id").agg(F.min("turn").alias("_final"))
    n = F.sum(((F.col("role") == "user") & (F.col("turn") < F.coalesce("_final", F.lit(1000000000)))).cast("long"))
    return c.join(marks, "conv_id", "left").groupBy("conv_id").agg(F.nullif(n, F.lit(0)).alias("questions"))


def intent_ladder(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("role", T.intent(F.col("text"), ("write ", "list "), ("should ", "because")).alias("intent")).agg(F.count("*").alias("n"))


def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def title_keys(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    title = F.concat(F.lit("The Matter of O'Neil & Co. at "), F.col("p_name"), F.lit(" by or for it"))
    return p.groupBy(T.case_key(F.col("p_type"), F.col("p_name")).alias("key"), T.normalized_title(title).alias("title")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    sentence_stats, lexical_overlap, pronoun_density, readability, keyword_flags, domain_argmax, multi_labels, rule_classifier, url_normalize,
    content_hash_dupes, redacted_texts, questions_before_final, intent_ladder, json_props, title_keys,
)}

_SENTENCES = """list_filter(list_transform(string_split(regexp_replace({t}, '[.!?]+[ \\t\\n\\r\\f\\x0B]+([A-Z])', chr(1) || '\\1', 'g'), chr(1)),
  lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: length(s) > {n})"""
_WORDS = "list_filter(regexp_split_to_array(lower({t}), '[ \\t\\n\\r]+'), lambda w: w <> '')"
_HAS = "contains(lower(text), '{}')"


def _label_hits(terms):
    return " + ".join(f"{_HAS.format(t)}::INT" for t in terms)


_MATCHES = "list_distinct(list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'legal' END, CASE WHEN regexp_matches(text, '@[a-zA-Z0-9_]+') THEN 'contact' END, CASE WHEN regexp_matches(text, '(?i)token|key') THEN 'secret' END, CASE WHEN regexp_matches(text, '(?i)(^|[^a-zA-Z0-9_])idiot($|[^a-zA-Z0-9_])') THEN 'rude' END], lambda x: x IS NOT NULL))"

ORACLES = {
    "sentence_stats": f"WITH s AS (SELECT doc_id, {_SENTENCES.format(t='text', n=10)} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS chars FROM s",
    "lexical_overlap": f"""WITH s AS (SELECT doc_id, length(text) AS n, {_SENTENCES.format(t='text', n=10)} AS s FROM documents),
w AS (SELECT doc_id, n, list_transform(s, lambda x: list_distinct({_WORDS.format(t='x')})) AS w FROM s),
p AS (SELECT doc_id, avg(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END) AS m
  FROM (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS d, count(*) FILTER (c > 1) AS r FROM (
  SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(flatten(list_transform(w, lambda l: list_filter(l, lambda y: length(y) > 3)))) AS x FROM w) GROUP BY ALL) GROUP BY 1)
SELECT w.doc_id, CASE WHEN n >= 50 AND len(w) >= 2 THEN round(m, 3) + 0.0 END AS adjacent, CASE WHEN len(w) >= 2 THEN round(r / d, 3) + 0.0 END AS overall
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "pronoun_density": f"""SELECT doc_id, CASE WHEN len({_WORDS.format(t='text')}) > 0 THEN round(100.0 * len(regexp_extract_all(regexp_replace(lower(text), '[\u00c0-\u024f]', 'x', 'g'), '\\b(?:i|you|he|she|it|we|they|me|him|her|us|them|my|your|his|its|our|their)\\b')) / len({_WORDS.format(t='text')}), 2) END AS per_hundred
FROM documents""",
    "readability": f"""WITH d AS (SELECT doc_id, length(text) AS n, {_WORDS.format(t='text')} AS w, greatest(len({_SENTENCES.format(t='text', n=0)}), 1) AS s,
  len(regexp_extract_all(lower(text), '[aeiouy]+')) AS v FROM documents)
SELECT doc_id, CASE WHEN n >= 50 THEN round(least(20.0, greatest(0.0, 0.39 * len(w)::DOUBLE / s + 11.8::DOUBLE * greatest(v, len(w)) / greatest(len(w), 1) - 15.59)), 2) END AS grade,
       CASE WHEN n >= 50 THEN round(least(20.0, 1.0430 * sqrt(len(list_filter(w, lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3)) * 30.0::DOUBLE / s) + 3.1291), 2) END AS smog FROM d""",
    "keyword_flags": f"""SELECT doc_id, {' OR '.join(_HAS.format(t) for t in TERMS)} AS any_term, {_label_hits(TERMS)} AS n_terms,
       len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents""",
    "domain_argmax": f"""WITH h AS (SELECT lang, {', '.join(f'{_label_hits(t)} AS {name}' for name, t in LABELS)} FROM documents)
SELECT lang, CASE WHEN greatest(english, german, french) = 0 THEN NULL WHEN english >= german AND english >= french THEN 'english' WHEN german >= french THEN 'german' ELSE 'french' END AS label,
       count(*) AS n FROM h GROUP BY ALL""",
    "multi_labels": f"""SELECT coalesce(nullif(concat_ws(',', {', '.join(f"CASE WHEN {' OR '.join(_HAS.format(x) for x in t)} THEN '{name}' END" for name, t in LABELS)}), ''), 'none') AS labels,
       count(*) AS n FROM documents GROUP BY 1""",
    "rule_classifier": f"""WITH m AS (SELECT {_MATCHES} AS raw FROM documents),
o AS (SELECT list_filter(['legal', 'contact', 'secret', 'rude'], lambda x: list_contains(raw, x)) AS m FROM m)
SELECT coalesce(m[1], 'plain') AS first, CASE WHEN list_contains(m, 'rude') THEN 'rude' WHEN list_contains(m, 'secret') THEN 'secret' ELSE coalesce(m[1], 'plain') END AS prioritized,
       array_to_string(m, ',') AS matches, count(*) AS n FROM o GROUP BY ALL""",
    "url_normalize": f"""WITH b AS (SELECT page_id, regexp_replace(lower(trim(url)), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, regexp_replace(split_part(u, '?', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(CASE WHEN contains(u, '?') THEN regexp_extract(u, '\\?(.*)$', 1) ELSE '' END, '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_|ref=|source=|click=)'))) AS q FROM b)
SELECT page_id, CASE WHEN len(q) > 0 THEN path || '?' || array_to_string(q, '&') ELSE path END AS url FROM p""",
    "content_hash_dupes": "SELECT copies, count(*) AS texts FROM (SELECT count(*) AS copies FROM documents GROUP BY text) GROUP BY 1",
    "redacted_texts": r"""WITH r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?i)\b(?:the|and|idiot)\b', '', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM r""",
    "questions_before_final": """WITH m AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE contains(text, 'The ') GROUP BY 1)
SELECT conv_id, nullif(count(*) FILTER (role = 'user' AND turn < coalesce(f, 1000000000)), 0)::BIGINT AS questions FROM conversations LEFT JOIN m USING (conv_id) GROUP BY 1""",
    "intent_ladder": f"""SELECT role, CASE WHEN contains(lower(text), 'write ') OR contains(lower(text), 'list ') THEN 'order_test'
  WHEN contains(lower(text), 'should ') OR contains(lower(text), 'because') THEN 'recommendation' WHEN contains(text, '?') THEN 'question'
  WHEN len({_WORDS.format(t='text')}) < 5 THEN 'short' ELSE 'response' END AS intent, count(*) AS n FROM conversations GROUP BY ALL""",
    "json_props": "SELECT event_type, sum((props::JSON->>'k')::BIGINT)::BIGINT AS total, count(props::JSON->>'k') AS n FROM events GROUP BY 1",
    "title_keys": """SELECT substr(lower(substr(p_type, 1, 10)) || '-' || regexp_replace(p_name, '[^a-z0-9]+', '-', 'g'), 1, 64) AS key, 'matter oneil & co ' || lower(p_name) || ' by it' AS title, count(*) AS n FROM part GROUP BY ALL""",
}
