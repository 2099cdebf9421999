"""Queries over pages and titles as discovered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import crawl as C
from assayer.operators import discovery as D
from assayer.operators import votes as V
from assayer.plans.tables import RATINGS, ratings, read


def source_priorities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    title = F.concat(F.col("p_name"), F.when(F.col("p_size") > 25, F.lit(" v other")).otherwise(F.lit("")))
    score = D.source_priority(title, F.col("p_type"), F.col("p_size") + 2000, ["ring", "red", "widget", "small", "blue"], [("econ", 0.2), ("promo", 0.1)])
    return p.groupBy(score.alias("score")).agg(F.count("*").alias("n"))


def page_years(spark, sf_dir):
    """Page numbers as years of an address."""
    p = read(spark, sf_dir, "pages").select("page_id", D.year_of(F.concat(F.lit("http://h/"), (F.col("page_id") % 300 + 1850).cast("string"), F.lit("/x"))).alias("year"))
    return p


def content_checks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    why = D.content_check(F.col("text"), ["the ", "and ", "of ", "der ", "les ", "los ", "in "], ["tion", "ung", "ment"], ["idiot", "###"], 3, 1)
    return d.groupBy("lang", why.alias("reason")).agg(F.count("*").alias("n"))


def structure_checks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    why = D.structure_check(F.col("text"), F.size(F.split("text", "\n")), 1000, 4)
    return d.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def case_addresses(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", D.case_address(F.col("url"), ["/en/", "/fr/"], ["page=", "#"]).alias("wanted"))


def seed_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    hosts = ["www.example.com", "m.ththth.example.net", "thther.example.org"]
    return D.seeds(p, hosts, p.where("url LIKE '%ref=%'").select("url"))


def link_crawl(spark, sf_dir):
    """Everything that links of the English pages lead to, two levels deep."""
    p = read(spark, sf_dir, "pages")
    return C.crawled(p, p.where("url LIKE '%/en/%'").select("url"), depth=2).visited


def majority_and_mean(spark, sf_dir):
    """How two ways to combine raters relate."""
    r = V.with_votes(ratings(spark, sf_dir), ("claude", "grok", "gpt5")).where("majority IS NOT NULL")
    return r.groupBy("llm_name").agg(F.count("*").alias("n"), F.round(F.avg("majority"), 6).alias("majority"), F.round(F.avg("mean_score"), 6).alias("mean"), F.round(F.corr("majority", "mean_score"), 6).alias("r"))


QUERIES = {f.__name__: f for f in (source_priorities, page_years, content_checks, structure_checks, case_addresses, seed_pages, link_crawl, majority_and_mean)}


def _hits(terms):
    return " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms)


ORACLES = {
    "source_priorities": """WITH s AS (SELECT round(least(1.0, 0.5 + CASE WHEN regexp_matches(p_type, '(?i)econ') THEN 0.2 WHEN regexp_matches(p_type, '(?i)promo') THEN 0.1 ELSE 0 END
  + least(0.2, 0.05 * (contains(p_name, 'ring')::INT + contains(p_name, 'red')::INT + contains(p_name, 'widget')::INT + contains(p_name, 'small')::INT + contains(p_name, 'blue')::INT))
  + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END + CASE WHEN p_size >= 15 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM part)
SELECT score, count(*) AS n FROM s GROUP BY 1""",
    "page_years": "SELECT page_id, CASE WHEN page_id % 300 + 1850 BETWEEN 1900 AND 2099 THEN (page_id % 300 + 1850)::INT END AS year FROM pages",
    "content_checks": f"""WITH h AS (SELECT lang, {_hits(['the ', 'and ', 'of ', 'der ', 'les ', 'los ', 'in '])} AS m, {_hits(['tion', 'ung', 'ment'])} AS s, {_hits(['idiot', '###'])} AS b FROM documents)
SELECT lang, CASE WHEN b > 0 AND s <= b THEN 'disqualified' WHEN m < 3 THEN 'few_terms' WHEN s < 1 THEN 'few_strong_terms' END AS reason, count(*) AS n FROM h GROUP BY ALL""",
    "structure_checks": "SELECT CASE WHEN length(text) < 1000 THEN 'too_short' WHEN len(string_split(text, chr(10))) < 4 THEN 'no_structure' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "case_addresses": "SELECT page_id, (contains(url, '/en/') OR contains(url, '/fr/')) AND NOT (contains(url, 'page=') OR contains(url, '#')) AS wanted FROM pages",
    "majority_and_mean": f"""WITH {RATINGS}, v AS (SELECT llm_name, CASE WHEN grok = gpt5 THEN grok ELSE claude END AS m, round((claude + grok + gpt5) / 3, 3) AS a FROM ratings WHERE claude IS NOT NULL AND grok IS NOT NULL AND gpt5 IS NOT NULL)
SELECT llm_name, count(*) AS n, round(avg(m), 6) AS majority, round(avg(a), 6) AS mean, round(corr(m, a), 6) AS r FROM v GROUP BY 1""",
}
