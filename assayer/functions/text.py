"""Text measures and predicates as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row though the expression names it often.

    The end of a fold over nothing: an element taken from an array would ask its whole expression for its type, row by row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def quoted(terms: Sequence[str], bounded: bool = False) -> str:
    """One case-insensitive pattern for all terms."""
    inner = "|".join(re.escape(t) for t in terms)
    return rf"(?iu)\b(?:{inner})\b" if bounded else f"(?iu)(?:{inner})"


def mentions(col: Column, terms: Sequence[str], bounded: bool = False) -> Column:
    """Whether any term occurs, as a substring unless bounded. Null texts mention nothing."""
    return F.coalesce(col.rlike(quoted(terms, bounded)), F.lit(False)) if terms else F.lit(False)


def terms_present(col: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    low = F.lower(F.coalesce(col, F.lit("")))
    out = F.lit(0)
    for t in terms:
        out = out + low.contains(t.lower()).cast("int")
    return out


def occurrences(col: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(pattern))


def first_match(col: Column, patterns: Sequence[str]) -> Column:
    """The whole match of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col, p, 0), F.lit("")) for p in patterns])


def sentences(col: Column, least: int = 10) -> Column:
    """Parts that end in . ! or ? before white space and an ASCII capital, trimmed, longer than `least` characters."""
    parts = F.split(F.coalesce(col, F.lit("")), r"[.!?]+\s+(?=[A-Z])")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: F.length(s) > least)


def words(col: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[ \t\n\r]+"), lambda w: w != "")


def adjacent_overlap(col: Column) -> Column:
    """Mean Jaccard similarity of neighbouring sentences' words, 3 digits; null below 50 characters or two sentences."""

    def mean(sets: Column) -> Column:
        pairs = F.zip_with(F.slice(sets, F.lit(1), F.size(sets) - 1), F.slice(sets, F.lit(2), F.size(sets) - 1), jaccard)
        return F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y) / F.size(pairs)

    sets = F.transform(sentences(col), lambda s: F.array_distinct(words(s)))
    return F.when(F.length(col) >= 50, let(sets, lambda x: F.when(F.size(x) >= 2, F.round(mean(x), 3))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def global_overlap(col: Column, least: int = 3) -> Column:
    """Share of distinct words longer than `least` that stand in more than one sentence, 3 digits."""
    sets = F.transform(sentences(col), lambda s: F.filter(F.array_distinct(words(s)), lambda w: F.length(w) > least))

    def repeated(ordered: Column) -> Column:
        """In the sorted list of all sentences' sets: the distinct words among those equal to the word before them."""
        again = F.zip_with(F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1), lambda x, y: F.when(x == y, x))
        return F.size(F.array_distinct(F.array_compact(again)))

    def share(ordered: Column) -> Column:
        return F.when(F.size(ordered) > 0, F.round(repeated(ordered) / F.size(F.array_distinct(ordered)), 3))

    return let(sets, lambda x: F.when(F.size(x) >= 2, let(F.array_sort(F.flatten(x)), share)))


#: Pronouns counted: fixed values.
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their")


def pronoun_density(col: Column, pronouns: Sequence[str] = PRONOUNS) -> Column:
    """Pronouns for each hundred words, 2 digits."""
    n = F.size(words(col))
    hits = F.regexp_count(F.lower(col), F.lit(r"\b(?:" + "|".join(pronouns) + r")\b"))
    return F.when(n > 0, F.round(100.0 * hits / n, 2))


def syllables(col: Column) -> Column:
    """Vowel groups of ASCII words, one at least for each word."""
    return F.greatest(F.regexp_count(F.lower(col), F.lit("[aeiouy]+")), F.size(words(col)))


def grade_level(col: Column) -> Column:
    """Flesch-Kincaid grade in 0..20, 2 digits; null below 50 characters."""
    n = F.size(words(col))
    grade = 0.39 * n / F.greatest(F.size(sentences(col, 0)), F.lit(1)) + 11.8 * syllables(col) / F.greatest(n, F.lit(1)) - 15.59
    return F.when(F.length(col) >= 50, F.round(F.least(F.lit(20.0), F.greatest(F.lit(0.0), grade)), 2))


def smog_index(col: Column) -> Column:
    """SMOG in 0..20, 2 digits, from words of three vowel groups or more."""
    hard = F.size(F.filter(words(col), lambda w: F.regexp_count(w, F.lit("[aeiouy]+")) >= 3))
    smog = 1.0430 * F.sqrt(hard * 30.0 / F.greatest(F.size(sentences(col, 0)), F.lit(1))) + 3.1291
    return F.when(F.length(col) >= 50, F.round(F.least(F.lit(20.0), smog), 2))


def without_terms(col: Column, terms: Sequence[str]) -> Column:
    """The text without whole-word terms, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, quoted(terms, True), ""), r"\s+", " "))


def without_thoughts(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)<think>.*?</think>\s*", "")


def unfenced(col: Column) -> Column:
    """The inside of the first code fence, else the text."""
    return F.coalesce(F.nullif(F.regexp_extract(col, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), col)


def json_list(col: Column, schema: str) -> Column:
    """The outermost JSON list in a text, parsed; null if there is none."""
    return F.from_json(F.regexp_extract(col, r"(?s)(\[.*\])", 1), schema)


def iso_time(col: Column) -> Column:
    """ISO time stamps, Z for UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(col, "Z$", "+00:00"))


DATE_FORMATS = ("yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy")


def any_date(col: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(f)) for f in formats]).cast("date")


#: Starts of parameters that only track visitors: fixed values.
TRACKING = ("utm_", "ref=", "source=", "click=")


def normalized_url(col: Column, tracking: Sequence[str] = TRACKING) -> Column:
    """Lower case, https by default, no trailing slash, no fragment, no tracking parameters, the others sorted."""
    low = F.lower(F.trim(col))
    bare = F.regexp_replace(F.when(low.rlike("^[a-z][a-z0-9+.-]*://"), low).otherwise(F.concat(F.lit("https://"), low)), "#.*$", "")
    path = F.regexp_replace(F.substring_index(bare, "?", 1), "/+$", "")
    query = F.when(bare.contains("?"), F.regexp_extract(bare, r"\?(.*)$", 1)).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:" + "|".join(map(re.escape, tracking)) + ")")))
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), F.array_join(kept, "&"))).otherwise(path)


#: Words left out of titles: fixed values.
TITLE_STOP = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for")


def normalized_title(col: Column, stop: Sequence[str] = TITLE_STOP) -> Column:
    parts = F.split(F.trim(F.regexp_replace(F.lower(col), r"(?U)[^\w\s&]", "")), r"\s+")
    return F.array_join(F.filter(parts, lambda w: (w != "") & ~w.isin(*stop)), " ")


def content_hash(col: Column) -> Column:
    """Sixteen hex digits; equal texts, equal hashes."""
    return F.lower(F.lpad(F.hex(F.xxhash64(col)), 16, "0"))


def case_key(source: Column, name: Column) -> Column:
    """An id of at most 64 characters: the source's first ten, then the name, other signs as single dashes."""
    clean = F.btrim(F.regexp_replace(F.lower(F.concat_ws("-", F.substring(source, 1, 10), name)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(clean, 1, 64)


def word_estimate(col: Column) -> Column:
    """Words taken as five characters each."""
    return F.length(col) / 5


def token_estimate(col: Column) -> Column:
    """Tokens taken as four characters each."""
    return F.ceil(F.length(col) / 4)


def intent(col: Column, orders: Sequence[str], advice: Sequence[str]) -> Column:
    """order_test, recommendation, question, short (below five words) or response: the first that applies."""
    return (
        F.when(mentions(col, orders), "order_test")
        .when(mentions(col, advice), "recommendation")
        .when(F.coalesce(col, F.lit("")).contains("?"), "question")
        .when(F.size(words(col)) < 5, "short")
        .otherwise("response")
    )


def best_label(col: Column, labels: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The label with the most terms present; of equals the first; null if none occurs."""
    scored = F.array(*[F.struct(terms_present(col, terms).alias("hits"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (label, terms) in enumerate(labels)])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["label"])


def all_labels(col: Column, labels: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Every label with a term present, in order."""
    found = F.array_compact(F.array(*[F.when(mentions(col, terms), label) for label, terms in labels]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default))) if default else found


def context_of(col: Column, term: str, radius: int = 200) -> Column:
    """Up to radius characters on both sides of the first occurrence, with the occurrence."""
    at = F.locate(term, col)
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substr(col, start, at - start + len(term) + radius))
