"""Queries over prices, vectors, queues and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assayer.operators import cost as C
from assayer.operators import frontier as N
from assayer.operators import graph as G
from assayer.operators import similarity as V
from assayer.operators import vector_index as X
from assayer.plans.tables import read
from assayer.sources import layout as L
from assayer.sources.stored import kept_until_end, shared_dir, written
from assayer.streaming import ledger as T


def price_fallback(spark, sf_dir):
    """Line items priced in the plan of their supplier's region, else in the plan that was loaded first."""
    prices = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("plan"), F.col("p_partkey").alias("load_ordinal"), F.col("p_retailprice").alias("amount"))
    more = prices.select("code", F.concat(F.lit("Brand#"), (F.col("code") % 7).cast("string")).alias("plan"), (F.col("code") + 1_000_000).alias("load_ordinal"), (F.col("amount") * 2).alias("amount"))
    wanted = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 7).cast("string")).alias("plan"))
    out = C.priced(wanted, prices.unionByName(more))
    return out.groupBy("plan", "price_plan").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 1).alias("amount"))


def cost_totals(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").withColumn("charge", F.when(F.col("l_discount") > 0.08, 0.0).otherwise(F.col("l_extendedprice"))).withColumn("hit", F.col("l_tax") > 0.02)
    out = C.cost_totals(line, ["l_suppkey"], ["charge"], "hit")
    return out.withColumns({"match_rate": F.round("match_rate", 6), "total_charge": F.round("total_charge", 1)})


def price_stats(spark, sf_dir):
    out = C.price_stats(read(spark, sf_dir, "part"), "p_retailprice", "p_partkey", "p_type")
    return out.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


def cost_run_summary(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("procedure_count"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))
    out = C.run_summary(line, "cost")
    return out.withColumns({c: F.round(c, 3) for c in ("with_procedures", "mean_cost", "median_cost")})


def procedure_profile(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_linestatus", "l_orderkey", "l_returnflag")
    out = C.procedure_profile(line, "l_linestatus", "l_orderkey", "l_returnflag", ["A", "N", "R"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_A", "mean_N", "mean_R", "mean_total")})


def top_procedures(spark, sf_dir):
    out = C.top_procedures(read(spark, sf_dir, "part"), "p_name", "p_retailprice")
    return out.withColumn("mean_cost", F.round("mean_cost", 4))


def extracted_procedures(spark, sf_dir):
    rows = [(1, "token", "secret", "lab"), (2, "licen", "license", "imaging"), (3, "@", "mail", "lab"), (4, "password", "secret", "lab")]
    table = spark.createDataFrame(rows, "ordinal int, keyword string, name string, category string")
    found = C.extracted_procedures(read(spark, sf_dir, "documents"), table, "doc_id", "text")
    return found.groupBy("name", "category", "keyword").agg(F.count("*").alias("n"))


def cosine_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    labels = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.drop("label"), "vec_id").select(F.col("vec_id").alias("code"), "embedding")
    index = X.built(written(labels), "code", "embedding", kept_until_end(spark, f"{shared_dir(spark)}/label-vectors"))
    return X.search(index, e, "vec_id", "embedding", k=2, threshold=0.1).withColumn("score", F.round("score", 4) + 0.0)


def _all_vectors(spark, e):
    """The stored index of all embeddings; built by whichever query comes first, read by the others."""
    return X.built(e, "vec_id", "embedding", kept_until_end(spark, f"{shared_dir(spark)}/all-vectors"))


def vector_search(spark, sf_dir):
    """Every vector's five nearest others."""
    e = read(spark, sf_dir, "embeddings")
    out = X.search(_all_vectors(spark, e), e, "vec_id", "embedding", k=5, threshold=0.3, same=True)
    return out.withColumn("score", F.round("score", 6) + 0.0)


def nearest_codes(spark, sf_dir):
    """Every group's mean vector with the one vector that is nearest to it, as procedures are matched with codes."""
    e = read(spark, sf_dir, "embeddings")
    parts = e.select("label", F.pmod(F.col("vec_id"), F.lit(40)).alias("procedure"), F.posexplode("embedding").alias("place", "x"))
    means = parts.groupBy("label", "procedure", "place").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label", "procedure")
    asked = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("mean")).withColumn("procedure", F.concat_ws("-", "label", "procedure"))
    out = X.search(_all_vectors(spark, e), asked, "procedure", "mean", k=1, threshold=0.4)
    return out.select("procedure", "code", (F.round("score", 6) + 0.0).alias("score"))


def coherence_closed_form(spark, sf_dir):
    e = V.normalized(read(spark, sf_dir, "embeddings"), "embedding")
    dims = e.select(F.size("unit").alias("n")).first()["n"]
    out = V.mean_pairwise(e, "unit", "label", dims)
    return out.withColumn("coherence", F.round("coherence", 6) + 0.0)


def pending_antijoin(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


def queue_top_priority(spark, sf_dir):
    """The limit is the feature: the next fifty to work on."""
    queue = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("priority_score"))
    return G.next_in_queue(queue, "P", 50, "o_orderkey")


def upsert_latest(spark, sf_dir):
    return C.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def status_fold(spark, sf_dir):
    """Users as cases: the tens of each event's property are the status that it reports."""
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in T.STATUSES]), (F.floor(F.get_json_object("props", "$.k").cast("int") / 10) + 1).cast("int"))
    told = T.advanced(e.select(F.col("user_id").alias("case_id"), "event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("at")))
    lost = F.count(F.when(F.col("kind") == "illegal", 1))
    return told.groupBy("case_id").agg(F.max(F.when(F.col("kind") == "state", F.col("status"))).alias("status"), F.coalesce(F.max(F.when(F.col("kind") == "state", F.col("changes"))), F.lit(0)).alias("changes"), lost.alias("illegal"))


def insert_ignore(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return G.new_rows(pages, pages.where("url LIKE 'https%'").select("url"), ["url"]).select("page_id", "url")


def coalesced_update(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    patch = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("n_name"))
    return G.patched(n, patch, "n_nationkey", ["n_name"])


def citation_bfs(spark, sf_dir):
    """Customers reached from segment leaders through orders that name them: key modulo the number of customers."""
    o = read(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), F.floor(F.col("o_totalprice") % 997).cast("long").alias("dst"))
    seeds = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("node")).select("node")
    return G.expanded(seeds, edges, 2)


def citation_frontier(spark, sf_dir):
    """Finds from the wealthiest customer of each segment, along orders that are not of low priority, beyond customers in debt. The cap is the feature."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    edges = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("place"), F.floor(F.col("o_totalprice") % 997).cast("long").alias("dst"), "o_orderpriority")
    seeds = c.groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("node")).select("node", F.col("node").alias("seed_rank"))
    known = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return N.explored(seeds, edges, ~F.col("o_orderpriority").startswith("5"), known, depth=2, most=400).nodes


def citation_degrees(spark, sf_dir):
    edges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.floor(F.col("o_totalprice") % 997).cast("long").alias("dst"))
    return G.degrees(edges)


def quota_per_year(spark, sf_dir):
    """The quota is the feature: at most a few orders of each year."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return G.yearly_sweep(o, "year", [F.desc("o_totalprice"), F.col("o_orderkey")], 7, 100)


def filter_chain(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("base", F.lit(0.5))
    rules = [("small", F.col("p_size") >= 5, F.lit(0.1)), ("cheap", F.col("p_retailprice") >= 950, F.lit(0.2)), ("kind", F.col("p_type").isin("ECONOMY", "STANDARD"), F.lit(0.4))]
    return G.decided(p, rules, "base").groupBy("reason", F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))


def stored_criteria(spark, sf_dir):
    """Orders as runs and their line items as criteria, exported as bucketed tables and joined there without a shuffle."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("llm_name"), (F.col("o_orderstatus") == "F").alias("risk_flag"))
    criteria = line.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("criterion"), (F.col("l_returnflag") == "N").alias("met"))
    name = f"stored_{uuid.uuid4().hex}"
    made = L.export_tables(runs, criteria, kept_until_end(spark, f"{shared_dir(spark)}/{name}"), name)
    out = L.joined(spark, made).groupBy("llm_name", "risk_flag")
    return out.agg(F.count("*").alias("criteria"), F.sum("met").alias("met"), F.countDistinct("run_id").alias("runs"))


QUERIES = {f.__name__: f for f in (
    price_fallback, cost_totals, price_stats, cost_run_summary, procedure_profile, top_procedures, extracted_procedures, cosine_topk, vector_search, nearest_codes,
    coherence_closed_form, pending_antijoin, queue_top_priority, upsert_latest, status_fold, insert_ignore, coalesced_update, citation_bfs, citation_frontier, citation_degrees,
    quota_per_year, filter_chain, stored_criteria,
)}

_EDGES = "e AS (SELECT o_custkey AS src, floor(o_totalprice % 997)::BIGINT AS dst FROM orders)"
ORACLES = {
    "price_fallback": """WITH p AS (SELECT p_partkey AS code, p_brand AS plan, p_partkey AS o, p_retailprice AS amount FROM part
  UNION ALL SELECT p_partkey, 'Brand#' || (p_partkey % 7), p_partkey + 1000000, p_retailprice * 2 FROM part),
l AS (SELECT code, plan, min(o) AS o, arg_max(amount, o) AS amount FROM p GROUP BY ALL),
w AS (SELECT l_partkey AS code, 'Brand#' || (l_suppkey % 7) AS plan, row_number() OVER () AS k FROM lineitem),
r AS (SELECT w.k, w.plan, l.plan AS price_plan, amount, row_number() OVER (PARTITION BY w.k ORDER BY (l.plan <> w.plan)::INT, l.o) AS rn FROM w LEFT JOIN l USING (code))
SELECT plan, price_plan, count(*) AS n, round(sum(amount), 1) AS amount FROM r WHERE rn = 1 GROUP BY ALL""",
    "cost_totals": """SELECT l_suppkey, count(*) AS procedure_count, count(*) FILTER (l_tax > 0.02)::BIGINT AS matched_count, round(avg((l_tax > 0.02)::INT), 6) AS match_rate,
       round(sum(l_extendedprice) FILTER (l_discount <= 0.08 AND l_extendedprice <> 0), 1) AS total_charge FROM lineitem GROUP BY 1""",
    "price_stats": """SELECT count(p_retailprice) AS n, min(p_retailprice) AS least, max(p_retailprice) AS most, round(median(p_retailprice), 4) AS median, round(avg(p_retailprice), 4) AS mean,
       count(DISTINCT p_partkey) AS codes, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS plans FROM part WHERE p_retailprice > 0""",
    "cost_run_summary": """WITH r AS (SELECT l_orderkey, count(*) AS c, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY 1)
SELECT count(*) AS runs, round(avg((c > 0)::INT), 3) AS with_procedures, sum(c)::BIGINT AS procedures, round(avg(cost) FILTER (cost > 0), 3) AS mean_cost, round(median(cost) FILTER (cost > 0), 3) AS median_cost FROM r""",
    "procedure_profile": """WITH r AS (SELECT l_linestatus, l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS t FROM lineitem GROUP BY ALL)
SELECT l_linestatus, round(avg(a), 6) AS mean_A, round(avg(n), 6) AS mean_N, round(avg(r), 6) AS mean_R, format('{:.1f}%', 100 * avg((a > 0)::INT)) AS with_A, format('{:.1f}%', 100 * avg((n > 0)::INT)) AS with_N,
       format('{:.1f}%', 100 * avg((r > 0)::INT)) AS with_R, round(avg(t), 6) AS mean_total, median(t)::DOUBLE AS median_total, max(t) AS max_total, count(*) AS runs FROM r GROUP BY 1""",
    "top_procedures": "SELECT p_name, count(*) AS n, round(avg(p_retailprice), 4) AS mean_cost FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20",
    "extracted_procedures": """WITH k(o, keyword, name, category) AS (VALUES (1, 'token', 'secret', 'lab'), (2, 'licen', 'license', 'imaging'), (3, '@', 'mail', 'lab'), (4, 'password', 'secret', 'lab')),
h AS (SELECT doc_id, name, category, keyword, row_number() OVER (PARTITION BY doc_id, name ORDER BY o) AS rn FROM documents JOIN k ON contains(lower(text), keyword))
SELECT name, category, keyword, count(*) AS n FROM h WHERE rn = 1 GROUP BY ALL""",
    "cosine_topk": """WITH c AS (SELECT e.vec_id AS code, e.embedding AS v FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) USING (vec_id)),
s AS (SELECT e.vec_id, code, list_cosine_similarity(e.embedding::DOUBLE[], v::DOUBLE[]) AS s FROM embeddings e, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, code)::INT AS rank FROM s WHERE s >= 0.1)
SELECT vec_id, code, round(s, 4) + 0.0 AS score, rank FROM r WHERE rank <= 2""",
    "vector_search": """WITH s AS (SELECT a.vec_id, b.vec_id AS code, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, code)::INT AS rank FROM s WHERE s >= 0.3)
SELECT vec_id, code, round(s, 6) + 0.0 AS score, rank FROM r WHERE rank <= 5""",
    "nearest_codes": """WITH x AS (SELECT label, vec_id % 40 AS procedure, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, procedure, place, avg(x) AS x FROM x GROUP BY ALL),
q AS (SELECT label || '-' || procedure AS procedure, list(x ORDER BY place) AS mean FROM m GROUP BY label, m.procedure),
s AS (SELECT procedure, vec_id AS code, list_cosine_similarity(mean, embedding::DOUBLE[]) AS s FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY procedure ORDER BY round(s, 12) DESC, code) AS k FROM s WHERE s >= 0.4)
SELECT procedure, code, round(s, 6) + 0.0 AS score FROM r WHERE k = 1""",
    "coherence_closed_form": """WITH p AS (SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n, round(avg(s), 6) + 0.0 AS coherence FROM n LEFT JOIN p USING (label) GROUP BY ALL""",
    "pending_antijoin": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "queue_top_priority": """SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS priority_score FROM orders
WHERE o_orderstatus = 'P' ORDER BY priority_score DESC NULLS LAST, o_orderkey LIMIT 50""",
    "upsert_latest": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "status_fold": """WITH n AS (SELECT ['queued', 'fetching', 'fetched', 'parsing', 'parsed', 'extracting', 'extracted', 'validated', 'rejected', 'error'] AS names),
e AS (SELECT user_id::VARCHAR AS case_id, list({'s': names[json_extract(props, '$.k')::INT // 10 + 1], 'ok': 0, 'bad': 0} ORDER BY ts, event_id) AS xs FROM events, n GROUP BY 1),
f AS (SELECT case_id, list_reduce([{'s': '', 'ok': 0, 'bad': 0}] || xs, lambda a, b: CASE
  WHEN (a.s IN ('', 'error') AND b.s = 'queued') OR (list_position(names, b.s) BETWEEN 2 AND 8 AND list_position(names, a.s) = list_position(names, b.s) - 1)
    OR (b.s IN ('rejected', 'error') AND list_position(names, a.s) <= 8 AND NOT (a.s = 'validated' AND b.s = 'error'))
  THEN {'s': b.s, 'ok': a.ok + 1, 'bad': a.bad} ELSE {'s': a.s, 'ok': a.ok, 'bad': a.bad + 1} END) AS r FROM e, n)
SELECT case_id, nullif(r.s, '') AS status, r.ok::BIGINT AS changes, r.bad::BIGINT AS illegal FROM f""",
    "insert_ignore": "SELECT min(page_id) AS page_id, url FROM pages WHERE url NOT LIKE 'https%' GROUP BY url",
    "coalesced_update": """SELECT n_nationkey, CASE WHEN n_nationkey < 5 AND n_nationkey <> 2 THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN region ON r_regionkey = n_nationkey""",
    "citation_bfs": f"""WITH {_EDGES}, s AS (SELECT min(c_custkey) AS node FROM customer GROUP BY c_mktsegment),
a AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM s)),
b AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM a) AND dst NOT IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM a))
SELECT node, 1 AS depth, 0.8::DOUBLE AS priority FROM a UNION ALL SELECT node, 2, 0.7::DOUBLE FROM b""",
    "citation_frontier": """WITH e AS (SELECT o_custkey AS src, o_orderkey AS place, floor(o_totalprice % 997)::BIGINT AS dst, o_orderpriority NOT LIKE '5%' AS ok FROM orders),
s AS (SELECT arg_max(c_custkey, (c_acctbal, c_custkey)) AS node FROM customer GROUP BY c_mktsegment),
known AS (SELECT node FROM s UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0),
a AS (SELECT dst, src, place, ok, src AS above FROM e JOIN s ON src = s.node QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src, place) = 1),
a1 AS (SELECT dst AS node, src AS cited_by, row_number() OVER (ORDER BY above, place) - 1 AS k FROM a WHERE ok AND dst NOT IN (SELECT node FROM known) QUALIFY k < 400),
b AS (SELECT dst, src, place, ok, k AS above FROM e JOIN a1 ON src = a1.node WHERE dst NOT IN (SELECT dst FROM a) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY k, place) = 1),
b1 AS (SELECT dst AS node, src AS cited_by, (SELECT count(*) FROM a1) + row_number() OVER (ORDER BY above, place) - 1 AS k FROM b WHERE ok AND dst NOT IN (SELECT node FROM known) QUALIFY k < 400)
SELECT node, 1 AS depth, 0.8::DOUBLE AS priority, cited_by, k AS found_as FROM a1 UNION ALL SELECT node, 2, 0.7::DOUBLE, cited_by, k FROM b1""",
    "citation_degrees": f"""WITH {_EDGES}, x AS (SELECT src AS node, count(DISTINCT dst) AS cites FROM e GROUP BY 1), y AS (SELECT dst AS node, count(DISTINCT src) AS cited_by FROM e GROUP BY 1)
SELECT node, coalesce(cites, 0) AS cites, coalesce(cited_by, 0) AS cited_by FROM x FULL JOIN y USING (node)""",
    "quota_per_year": """SELECT o_orderkey, year, o_totalprice FROM (SELECT o_orderkey, year(o_orderdate) AS year, o_totalprice,
  row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 14""",
    "filter_chain": """WITH d AS (SELECT p_size >= 5 AS a, p_retailprice >= 950 AS b, p_type IN ('ECONOMY', 'STANDARD') AS c FROM part)
SELECT CASE WHEN NOT a THEN 'small' WHEN NOT b THEN 'cheap' WHEN NOT c THEN 'kind' END AS reason,
       round(least(1.0, 0.5 + (CASE WHEN a THEN 0.1 ELSE 0 END) + (CASE WHEN a AND b THEN 0.2 ELSE 0 END) + (CASE WHEN a AND b AND c THEN 0.4 ELSE 0 END)), 4)::DOUBLE AS score, count(*) AS n FROM d GROUP BY ALL""",
    "stored_criteria": """SELECT o_orderpriority AS llm_name, (o_orderstatus = 'F')::INT AS risk_flag, count(*) AS criteria,
  sum((l_returnflag = 'N')::INT)::BIGINT AS met, count(DISTINCT o_orderkey) AS runs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
}
