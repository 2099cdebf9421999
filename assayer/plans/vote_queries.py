"""Queries over ratings, and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import stats as S
from assayer.operators import votes as V
from assayer.plans.tables import RATINGS, ratings, read

JUDGES = ("claude", "grok", "gpt5")


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def majority_vote(spark, sf_dir):
    voted = V.with_votes(ratings(spark, sf_dir), JUDGES).withColumns({"by_median": V.majority(JUDGES, "median"), "mode_of_four": V.first_mode(["human", *JUDGES])})
    return voted.groupBy("majority", "by_median", "mode_of_four", "three_way_tie", "mean_score").agg(F.count("*").alias("n"))


def rater_agreement(spark, sf_dir):
    return _rounded(V.agreement(ratings(spark, sf_dir), JUDGES), ["rate"])


def evaluator_grid(spark, sf_dir):
    return _rounded(V.evaluator_grid(ratings(spark, sf_dir), ["human", *JUDGES]), ["rate"])


def binary_agreement(spark, sf_dir):
    return _rounded(V.binary_agreement(ratings(spark, sf_dir).withColumn("majority", V.majority(JUDGES)), "human", "majority"), ["rate"])


def minority_votes(spark, sf_dir):
    return _rounded(V.minority_votes(ratings(spark, sf_dir), JUDGES), ["proportion"])


def minority_by_score(spark, sf_dir):
    return V.dissent(ratings(spark, sf_dir), JUDGES).where("dissenter IS NOT NULL").groupBy("dissenter", "minority_score").agg(F.count("*").alias("n"))


def split_patterns(spark, sf_dir):
    return V.split_patterns(ratings(spark, sf_dir), JUDGES)


def confusion_matrix(spark, sf_dir):
    return _rounded(V.confusion(ratings(spark, sf_dir), "human", "grok"), ["pct"])


def cohen_kappa(spark, sf_dir):
    r = ratings(spark, sf_dir)
    plain = V.kappa(r, "human", "grok").select("n", F.lit("plain").alias("kind"), "kappa")
    quad = V.kappa(r, "human", "grok", weighted=True).select("n", F.lit("quadratic").alias("kind"), "kappa")
    return _rounded(plain.union(quad), ["kappa"])


def kappa_by_model(spark, sf_dir):
    return _rounded(V.kappa(ratings(spark, sf_dir), "claude", "gpt5", by=["llm_name"]), ["kappa"])


def bootstrap_kappa(spark, sf_dir):
    return V.bootstrap_kappa(ratings(spark, sf_dir), "human", "grok", "run_id", samples=100)


def score_transitions(spark, sf_dir):
    return _rounded(V.transitions(ratings(spark, sf_dir), "human", "gpt5"), ["share"])


def self_evaluation_bias(spark, sf_dir):
    return _rounded(V.self_bias(ratings(spark, sf_dir), {"claude": "A", "grok": "N", "gpt5": "R"}, JUDGES, "llm_name"), ["own", "others", "bias"])


def spearman_by_group(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return _rounded(S.spearman(line, "l_quantity", "l_extendedprice", ["l_returnflag"]), ["r"])


def pearson_interval(spark, sf_dir):
    out = S.with_correlation_p(S.pearson(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"], 4))
    return _rounded(out, ["r", "p", "low", "high"])


def pearson_matrix(spark, sf_dir):
    return _rounded(S.correlation_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), ["r"])


def anova_eta2(spark, sf_dir):
    return _rounded(S.anova(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"), ["f", "eta2"]).drop("p")


def anova_by_stratum(spark, sf_dir):
    return _rounded(S.anova(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", ["o_orderstatus"]), ["f", "eta2"]).drop("p")


def kruskal_h(spark, sf_dir):
    return _rounded(S.kruskal(read(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), ["h"], 4).drop("p")


def wilcoxon_pairs(spark, sf_dir):
    return _rounded(S.wilcoxon_pairs(read(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), ["n1", "n2", "w", "effect", "z"], 4).drop("p", "p_bonferroni")


def welch_t(spark, sf_dir):
    return _rounded(S.two_samples(read(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderstatus") == "F"), ["m0", "m1", "t", "df", "d"], 4).drop("p")


def ols_line(spark, sf_dir):
    return _rounded(S.trend(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"]), ["slope", "intercept"], 4)


def quartiles(spark, sf_dir):
    return _rounded(S.quartiles(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"]), ["q1", "q2", "q3"], 4)


def proportions(spark, sf_dir):
    r = ratings(spark, sf_dir).where("human IS NOT NULL").groupBy("llm_name").agg(F.count("*").alias("n"), F.avg((F.col("human") == 2).cast("double")).alias("p"))
    return _rounded(r.withColumn("se", S.proportion_error(F.col("p"), F.col("n"))), ["p", "se"], 8)


QUERIES = {f.__name__: f for f in (
    majority_vote, rater_agreement, evaluator_grid, binary_agreement, minority_votes, minority_by_score, split_patterns, confusion_matrix,
    cohen_kappa, kappa_by_model, bootstrap_kappa, score_transitions, self_evaluation_bias, spearman_by_group, pearson_interval, pearson_matrix,
    anova_eta2, anova_by_stratum, kruskal_h, wilcoxon_pairs, welch_t, ols_line, quartiles, proportions,
)}

_DISSENT = """d AS (
  SELECT *, CASE WHEN grok = gpt5 THEN 'claude' WHEN claude = gpt5 THEN 'grok' WHEN claude = grok THEN 'gpt5' END AS dissenter,
         CASE WHEN grok = gpt5 THEN claude WHEN claude = gpt5 THEN grok WHEN claude = grok THEN gpt5 END AS minority_score,
         CASE WHEN grok = gpt5 THEN grok ELSE claude END AS majority_score
  FROM ratings WHERE claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL AND NOT (claude = grok AND grok = gpt5))"""


def _kappa(weight: str, kind: str, a: str = "human", b: str = "grok") -> str:
    w1, w2 = weight.format("x", "y"), weight.format("p.v", "q.v")
    return f"""SELECT '{kind}' AS kind, sum(n)::BIGINT AS n, round(1 - sum({w1} * n) * sum(n) / (
      SELECT sum({w2} * p.n * q.n) FROM (SELECT x AS v, sum(n) AS n FROM c GROUP BY 1) p, (SELECT y AS v, sum(n) AS n FROM c GROUP BY 1) q), 6) + 0.0 AS kappa FROM c"""


_C = "c AS (SELECT human AS x, grok AS y, count(*) AS n FROM ratings WHERE human IS NOT NULL AND grok IS NOT NULL GROUP BY ALL)"
_ANOVA = """g AS (SELECT {by} o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY ALL),
s AS (SELECT {by} sum(n) AS n, count(*) AS k, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum(n * v) AS w FROM g {group})
SELECT {by} n::BIGINT AS n, k, round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 6) AS eta2 FROM s"""
_RANKED = "(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0)"

ORACLES = {
    "majority_vote": f"""WITH {RATINGS},
v AS (SELECT *, claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL AS voted FROM ratings),
m AS (
  SELECT CASE WHEN voted THEN CASE WHEN grok = gpt5 THEN grok ELSE claude END END AS majority,
         CASE WHEN voted THEN list_sort([claude, grok, gpt5])[2] END AS by_median,
         (SELECT x FROM (SELECT unnest([human, claude, grok, gpt5]) AS x, unnest([1, 2, 3, 4]) AS k) WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, min(k) LIMIT 1) AS mode_of_four,
         claude <> grok AND grok <> gpt5 AND claude <> gpt5 AS three_way_tie, round((claude + grok + gpt5) / 3, 3) AS mean_score FROM v)
SELECT majority, by_median, mode_of_four, three_way_tie, mean_score, count(*) AS n FROM m GROUP BY ALL""",
    "rater_agreement": f"""WITH {RATINGS}
SELECT 'claude~grok' AS pair, count(*) AS n, round(avg((claude = grok)::INT), 6) + 0.0 AS rate FROM ratings WHERE claude IS NOT NULL AND grok IS NOT NULL
UNION ALL SELECT 'claude~gpt5', count(*), round(avg((claude = gpt5)::INT), 6) + 0.0 FROM ratings WHERE claude IS NOT NULL AND gpt5 IS NOT NULL
UNION ALL SELECT 'grok~gpt5', count(*), round(avg((grok = gpt5)::INT), 6) + 0.0 FROM ratings WHERE grok IS NOT NULL AND gpt5 IS NOT NULL
UNION ALL SELECT 'all', count(*), round(avg((claude = grok AND grok = gpt5)::INT), 6) + 0.0 FROM ratings WHERE claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL""",
    "evaluator_grid": f"""WITH {RATINGS},
l AS (UNPIVOT ratings ON human, claude, grok, gpt5 INTO NAME r VALUE s)
SELECT x.r AS a, y.r AS b, round(avg((x.s = y.s)::INT), 6) + 0.0 AS rate FROM
  (SELECT row_number() OVER () AS k, * FROM ratings) z,
  LATERAL (SELECT unnest(['human', 'claude', 'grok', 'gpt5']) AS r, unnest([z.human, z.claude, z.grok, z.gpt5]) AS s) x,
  LATERAL (SELECT unnest(['human', 'claude', 'grok', 'gpt5']) AS r, unnest([z.human, z.claude, z.grok, z.gpt5]) AS s) y
WHERE x.s IS NOT NULL AND y.s IS NOT NULL GROUP BY ALL""",
    "binary_agreement": f"""WITH {RATINGS},
m AS (SELECT human, CASE WHEN claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL THEN CASE WHEN grok = gpt5 THEN grok ELSE claude END END AS maj FROM ratings)
SELECT count(*) AS n, round(avg((human = maj)::INT), 6) + 0.0 AS rate FROM m WHERE human IN (0, 2) AND maj IN (0, 2)""",
    "minority_votes": f"""WITH {RATINGS}, {_DISSENT}
SELECT dissenter, count(*) AS votes, round(count(*) / (SELECT count(*) FROM d), 6) + 0.0 AS proportion FROM d WHERE dissenter IS NOT NULL GROUP BY 1""",
    "minority_by_score": f"WITH {RATINGS}, {_DISSENT} SELECT dissenter, minority_score, count(*) AS n FROM d WHERE dissenter IS NOT NULL GROUP BY ALL",
    "split_patterns": f"WITH {RATINGS}, {_DISSENT} SELECT concat_ws('_', dissenter, minority_score, 'vs', majority_score) AS pattern, count(*) AS n FROM d WHERE dissenter IS NOT NULL GROUP BY 1",
    "confusion_matrix": f"WITH {RATINGS}, {_C} SELECT x AS human, y AS grok, n, round(100 * n / sum(n) OVER (), 6) + 0.0 AS pct FROM c",
    "cohen_kappa": f"WITH {RATINGS}, {_C} {_kappa('({} <> {})::INT', 'plain')} UNION ALL {_kappa('({0} - {1}) * ({0} - {1})', 'quadratic')}",
    "kappa_by_model": f"""WITH {RATINGS},
c AS (SELECT llm_name, claude AS x, gpt5 AS y, count(*) AS n FROM ratings WHERE claude IS NOT NULL AND gpt5 IS NOT NULL GROUP BY ALL),
o AS (SELECT llm_name, sum(n) AS n, sum(n) FILTER (x = y) / sum(n) AS po FROM c GROUP BY 1),
e AS (SELECT p.llm_name, sum(p.n * q.n) AS pe FROM (SELECT llm_name, x AS v, sum(n) AS n FROM c GROUP BY ALL) p
      JOIN (SELECT llm_name, y AS v, sum(n) AS n FROM c GROUP BY ALL) q ON p.llm_name = q.llm_name AND p.v = q.v GROUP BY 1)
SELECT llm_name, n::BIGINT AS n, round((po - pe / (n * n)) / (1 - pe / (n * n)), 6) + 0.0 AS kappa FROM o JOIN e USING (llm_name)""",
    "score_transitions": f"""WITH {RATINGS}, c AS (SELECT human, gpt5, count(*) AS n FROM ratings GROUP BY ALL)
SELECT human, gpt5, n, round(n / sum(n) OVER (PARTITION BY human), 6) + 0.0 AS share FROM c""",
    "self_evaluation_bias": f"""WITH {RATINGS}, v AS (SELECT * FROM ratings WHERE claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL),
b AS (SELECT 'claude' AS rater, avg(claude) AS own, avg((grok + gpt5) / 2) AS others FROM v WHERE llm_name = 'A'
  UNION ALL SELECT 'grok', avg(grok), avg((claude + gpt5) / 2) FROM v WHERE llm_name = 'N'
  UNION ALL SELECT 'gpt5', avg(gpt5), avg((claude + grok) / 2) FROM v WHERE llm_name = 'R')
SELECT rater, round(own, 6) + 0.0 AS own, round(others, 6) + 0.0 AS others, round(own - others, 6) + 0.0 AS bias FROM b""",
    "spearman_by_group": f"""WITH r AS (SELECT l_returnflag, {_RANKED.format(p='l_returnflag', v='l_quantity')} AS x, {_RANKED.format(p='l_returnflag', v='l_extendedprice')} AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM r GROUP BY 1""",
    "pearson_matrix": """WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS c1, corr(l_quantity, l_discount) AS c2, corr(l_quantity, l_tax) AS c3,
       corr(l_extendedprice, l_discount) AS c4, corr(l_extendedprice, l_tax) AS c5, corr(l_discount, l_tax) AS c6 FROM lineitem)
SELECT unnest(['l_quantity', 'l_quantity', 'l_quantity', 'l_extendedprice', 'l_extendedprice', 'l_discount']) AS a,
       unnest(['l_extendedprice', 'l_discount', 'l_tax', 'l_discount', 'l_tax', 'l_tax']) AS b,
       round(unnest([c1, c2, c3, c4, c5, c6]), 6) + 0.0 AS r FROM m""",
    "anova_eta2": "WITH " + _ANOVA.format(by="", group=""),
    "anova_by_stratum": "WITH " + _ANOVA.format(by="o_orderstatus,", group="GROUP BY o_orderstatus"),
    "kruskal_h": f"""WITH r AS (SELECT l_returnflag, l_quantity, {_RANKED.replace('PARTITION BY {p} ', '').format(p='1', v='l_quantity').replace('PARTITION BY 1, l_quantity', 'PARTITION BY l_quantity')} AS k FROM lineitem),
g AS (SELECT l_returnflag, count(*) AS n, sum(k) AS s FROM r GROUP BY 1),
t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity)),
a AS (SELECT sum(n)::DOUBLE AS n, count(*) AS k, sum(s * s / n) AS q FROM g)
SELECT n::BIGINT AS n, k, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) + 0.0 AS h, k - 1 AS df FROM a, t""",
    "wilcoxon_pairs": """WITH c AS (SELECT l_returnflag AS g, l_quantity AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
p AS (SELECT x.g AS a, y.g AS b, sum(x.n * y.n * CASE WHEN x.v > y.v THEN 1.0 WHEN x.v = y.v THEN 0.5 ELSE 0.0 END) AS w FROM c x JOIN c y ON x.g < y.g GROUP BY ALL),
s AS (SELECT g, sum(n) AS n FROM c GROUP BY 1),
t AS (SELECT a, b, sum(u * u * u - u) AS ties FROM (SELECT p.a, p.b, c.v, sum(c.n) AS u FROM p JOIN c ON c.g IN (p.a, p.b) GROUP BY ALL) GROUP BY ALL),
z AS (SELECT p.a, p.b, x.n AS n1, y.n AS n2, w, ties, x.n + y.n AS n FROM p JOIN s x ON x.g = p.a JOIN s y ON y.g = p.b JOIN t ON t.a = p.a AND t.b = p.b)
SELECT a, b, n1, n2, round(w, 4) AS w, round(1 - 2 * w / (n1 * n2), 4) + 0.0 AS effect,
       round((w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))), 4) + 0.0 AS z FROM z""",
    "welch_t": """WITH a AS (SELECT count(*) FILTER (o_orderstatus <> 'F') AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1,
  avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS m0, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1,
  var_samp(o_totalprice) FILTER (o_orderstatus <> 'F') AS v0, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1 FROM orders)
SELECT n0, n1, round(m0, 4) + 0.0 AS m0, round(m1, 4) + 0.0 AS m1, round((m1 - m0) / sqrt(v0 / n0 + v1 / n1), 4) + 0.0 AS t,
       round((v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 4) + 0.0 AS df,
       round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) + 0.0 AS d FROM a""",
    "ols_line": "SELECT l_linestatus, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS intercept FROM lineitem GROUP BY 1",
    "quartiles": """SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 AS q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) + 0.0 AS q3, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL""",
    "proportions": f"""WITH {RATINGS}, p AS (SELECT llm_name, count(*) AS n, avg((human = 2)::INT) AS p FROM ratings WHERE human IS NOT NULL GROUP BY 1)
SELECT llm_name, n, round(p, 8) + 0.0 AS p, round(sqrt(p * (1 - p) / n), 8) + 0.0 AS se FROM p""",
}
