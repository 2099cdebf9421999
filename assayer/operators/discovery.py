"""Discovery of documents: citations, source priorities, filters and seeds. Term lists and patterns are configuration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import mentions, normalized_url, terms_present


@dataclass(frozen=True)
class Citation:
    """A citation form: its jurisdiction, its pattern with groups, and a template of an address that uses them, or none."""

    jurisdiction: str
    pattern: str
    url: str | None = None
    groups: tuple[int, ...] = ()


#: Neutral citations: year in brackets, court, number.
CITATIONS = (
    Citation("UK", r"\[(\d{4})\] (EWCA Civ|EWHC|UKSC) (\d+)", "https://example.invalid/uk/%s/%s/%s", (2, 1, 3)),
    Citation("CA", r"(\d{4}) (SCC|ONCA|BCCA) (\d+)", "https://example.invalid/ca/%s/%s/%s", (2, 1, 3)),
    Citation("AU", r"\[(\d{4})\] (HCA|NSWCA|VSCA) (\d+)", "https://example.invalid/au/%s/%s/%s", (2, 1, 3)),
    Citation("US", r"(\d+) (F\.[23]d|U\.S\.) (\d+)"),
)


def citations_in(text: Column, forms: Sequence[Citation] = CITATIONS) -> Column:
    """All citations of any form, each once, in the forms' order."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(c.pattern), F.lit(0)) for c in forms]
    return F.array_distinct(F.concat(*found))


def citation_jurisdiction(citation: Column, forms: Sequence[Citation] = CITATIONS) -> Column:
    return F.coalesce(*[F.when(citation.rlike(c.pattern), c.jurisdiction) for c in forms])


def citation_url(citation: Column, forms: Sequence[Citation] = CITATIONS) -> Column:
    """The address by the first form that fits; null for forms without a template."""
    out = F.lit(None).cast("string")
    for c in reversed(forms):
        parts = [F.replace(F.lower(F.regexp_extract(citation, c.pattern, g)), F.lit(" "), F.lit("-")) for g in c.groups]
        made = F.format_string(c.url, *parts) if c.url else F.lit(None).cast("string")
        out = F.when(citation.rlike(c.pattern), made).otherwise(out)
    return out


def year_of(address: Column) -> Column:
    """A year between slashes, else one in square brackets."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(address, p, 1), F.lit("")) for p in (r"/((?:19|20)\d{2})/", r"\[((?:19|20)\d{2})\]")])
    return found.cast("int")


def source_priority(title: Column, court: Column, year: Column, terms: Sequence[str], court_bonus: Sequence[tuple[str, float]], per_term: float = 0.05, versus: float = 0.1, recent: tuple[int, float] = (2015, 0.1)) -> Column:
    """0.5, a bonus by court, up to 0.2 for terms, and bonuses for a title of two parties and a recent year; at most 1."""
    bonus = F.lit(0.0)
    for pattern, value in reversed(court_bonus):
        bonus = F.when(court.rlike(f"(?i){pattern}"), value).otherwise(bonus)
    score = 0.5 + F.coalesce(bonus, F.lit(0.0)) + F.least(F.lit(0.2), per_term * terms_present(title, terms))
    score = score + F.when(F.lower(title).contains(" v "), versus).otherwise(0.0)
    score = score + F.when(F.coalesce(year >= recent[0], F.lit(False)), recent[1]).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(score, 6))


def case_address(url: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Whether an address has one of the wanted parts and none of the unwanted."""
    return mentions(url, include) & ~mentions(url, exclude)


def in_dates(date: Column, first: Column, last: Column) -> Column:
    """ISO dates compared as text; a missing date passes."""
    return date.isNull() | ((date >= first) & (date <= last))


def structure_check(text: Column, headings: Column, least_chars: int = 5000, least_headings: int = 2) -> Column:
    """Why a text's form fails, null if it passes."""
    return F.when(F.length(text) < least_chars, "too_short").when(headings < least_headings, "no_structure")


def content_check(text: Column, positive: Sequence[str], strong: Sequence[str], disqualifying: Sequence[str], least_positive: int = 5, least_strong: int = 2) -> Column:
    """Why a text's content fails, null if it passes. Disqualifying terms count unless the strong ones outnumber them."""
    many, hard, bad = terms_present(text, positive), terms_present(text, strong), terms_present(text, disqualifying)
    return F.when((bad > 0) & (hard <= bad), "disqualified").when(many < least_positive, "few_terms").when(hard < least_strong, "few_strong_terms")


def one_hop(texts: DataFrame, key: str, text: str, known: DataFrame, forms: Sequence[Citation] = CITATIONS) -> DataFrame:
    """key, citation, url of citations whose address is not known yet."""
    cited = texts.select(key, F.explode(citations_in(F.col(text), forms)).alias("citation")).withColumn("url", citation_url(F.col("citation"), forms))
    fresh = cited.where("url IS NOT NULL").withColumn("_u", normalized_url(F.col("url")))
    return fresh.join(known.select(normalized_url(F.col("url")).alias("_u")).distinct(), "_u", "left_anti").select(key, "citation", "url")


def seeds(rows: DataFrame, hosts: Sequence[str], known: DataFrame) -> DataFrame:
    """Seed rows of the given hosts, each address once, without known ones."""
    mine = rows.where(F.parse_url("url", F.lit("HOST")).isin(*hosts)).withColumn("_u", normalized_url(F.col("url")))
    first = mine.groupBy("_u").agg(F.min("url").alias("url"))
    return first.join(known.select(normalized_url(F.col("url")).alias("_u")).distinct(), "_u", "left_anti").select("url")


def facts_for(question: Column, topics: Sequence[tuple[str, Sequence[str]]], facts: Column, most: int = 15) -> Column:
    """Facts of the topics whose terms a question has, each once, in the topics' order. facts: map from topic to array."""
    found = [F.when(mentions(question, terms), facts[topic]) for topic, terms in topics]
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.flatten(F.array(*[F.coalesce(f, none) for f in found]))), 1, most)
