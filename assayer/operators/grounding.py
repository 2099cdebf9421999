"""Evidence held against the text that it is taken from.

What the evidence of a document asks for, its distinctive words and its paragraph references, is gathered once per document, each
of them once, in lists of bounded length; the text is read against a list at a time, and what it holds is joined back with the
evidence. So a text never stands beside each row of its evidence, and no text is shuffled more often than it has lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import let

#: Terms of a document in one list.
TERMS = 500
# Words that count, the share of them that must be found, the share of evidence that must be grounded.
FIRST_WORDS, LEAST_WORDS, LEAST_SCORE = 5, 0.5, 0.7


def distinctive(text: Column, common: Sequence[str], first: int = FIRST_WORDS) -> Column:
    """The first words of five plain letters or more that are not common, in order, repeats included."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.slice(F.filter(words, lambda w: w.rlike("^[a-z]{5,}$") & ~w.isin(*common)), 1, first)


def _quotable(ref: Column) -> Column:
    return F.regexp_replace(ref, r"\\E", "")


def reference_pattern(ref: Column) -> Column:
    """How a paragraph's number may stand in a text: [15], 15. at the start of a line, a pilcrow and 15, para or paragraph 15."""
    number = F.concat(F.lit("\\Q"), _quotable(ref), F.lit("\\E"))
    forms = (F.concat(F.lit(r"\["), number, F.lit(r"\]")), F.concat(F.lit("^"), number, F.lit(r"\.")), F.concat(F.lit(r"¶\s*"), number), F.concat(F.lit(r"para(?:graph)?\s*"), number))
    return F.concat(F.lit("(?mi)"), F.concat_ws("|", *forms))


def grounded(evidence: DataFrame, sources: DataFrame, key: str, evidence_id: str, text: str, ref: str, source: str, common: Sequence[str] = ()) -> DataFrame:
    """key, evidence_id, ref_found, n_words, n_found, grounded of each row of evidence (key, evidence_id, text, ref) against sources (key, source).

    Grounded is what has a reference that the source holds, or at least half of its distinctive words in it (as a part of others
    as well), or none. Evidence without a source has an empty one. Empty references are none. Keys are one in sources; rows of
    evidence that repeat are told once each.
    """
    asked = evidence.select(
        F.col(key).alias("k"), F.col(evidence_id).alias("e"), F.monotonically_increasing_id().alias("row"), distinctive(F.col(text), common).alias("words"),
        F.when(F.coalesce(ref, F.lit("")) != "", F.col(ref)).alias("ref"),
    )
    named = F.concat(F.transform("words", lambda w: F.struct(F.lit(False).alias("is_ref"), w.alias("term"))), F.when(F.col("ref").isNull(), F.array().cast("array<struct<is_ref:boolean,term:string>>")).otherwise(F.array(F.struct(F.lit(True).alias("is_ref"), F.col("ref").alias("term")))))
    terms = asked.select("k", "e", "row", F.size("words").alias("n_words"), F.explode_outer(named).alias("t")).select("k", "e", "row", "n_words", "t.is_ref", "t.term")
    distinct = terms.where("term IS NOT NULL AND k IS NOT NULL").select("k", "is_ref", "term").distinct()
    many = distinct.groupBy("k").agg(F.ceil(F.count("*") / TERMS).alias("lists"))
    lists = distinct.join(many, "k").groupBy("k", F.pmod(F.xxhash64("term"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct("is_ref", "term")).alias("terms"))
    read = lists.join(sources.select(F.col(key).alias("k"), F.col(source).alias("s")), "k")
    # the text is lowered once, as a lambda's argument, not for each term; a reference is looked for as it is before its pattern is tried
    here = F.struct(F.lower("s").alias("low"), F.upper("s").alias("up"))
    is_met = lambda t, x: F.when(t["is_ref"], F.contains(x["up"], F.upper(_quotable(t["term"]))) & F.regexp_like(F.col("s"), reference_pattern(t["term"]))).otherwise(F.contains(x["low"], t["term"]))
    met = let(here, lambda x: F.filter("terms", lambda t: is_met(t, x)))
    held = read.select("k", F.explode(met).alias("t")).select("k", "t.is_ref", "t.term", F.lit(1).alias("hit"))
    told = terms.join(held, ["k", "is_ref", "term"], "left").groupBy("row").agg(
        F.first("k").alias("k"), F.first("e").alias("e"), F.first("n_words").alias("n_words"),
        F.coalesce(F.max(F.col("is_ref") & F.col("hit").isNotNull()), F.lit(False)).alias("ref_found"), F.count(F.when(~F.col("is_ref"), F.col("hit"))).alias("n_found"),
    )
    enough = (F.col("n_words") == 0) | (F.col("n_found") >= F.col("n_words") * LEAST_WORDS)
    return told.select(F.col("k").alias(key), F.col("e").alias(evidence_id), "ref_found", "n_words", "n_found", (F.col("ref_found") | enough).alias("grounded"))


def grounding_scores(rows: DataFrame, key: str) -> DataFrame:
    """key, n, score, passes of the rows of grounded."""
    score = F.avg(F.col("grounded").cast("double"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), score.alias("score"), (score >= LEAST_SCORE).alias("passes"))
