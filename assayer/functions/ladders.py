"""Ordered first-match rules as Column expressions. The rules themselves are configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(col: Column, arms: Sequence[tuple[str, str]], default: Column | str | None = None, how: str = "regex") -> Column:
    """The label of the first arm (pattern, label) that matches; how: regex, contains, prefix or equals."""
    test = {"regex": col.rlike, "contains": col.contains, "prefix": col.startswith, "equals": col.__eq__}[how]
    out = None
    for pattern, label in arms:
        out = F.when(test(pattern), label) if out is None else out.when(test(pattern), label)
    rest = default if isinstance(default, Column) else F.lit(default)
    return rest if out is None else out.otherwise(rest)


def recode(col: Column, names: Mapping[str, str], default: Column | None = None) -> Column:
    """A dictionary recode; without a default unknown values pass through."""
    if not names:
        return col if default is None else default
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[col], col if default is None else default)


def bucket(col: Column, limits: Sequence[tuple[float, str]], rest: str) -> Column:
    """The label of the first limit that is above the value; null stays null."""
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(col < limit, label)
    return out.otherwise(rest)


def titled(col: Column) -> Column:
    """Underscores to spaces, words capitalised."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def excluded(col: Column, values: Sequence[str]) -> Column:
    """True for rows to keep when values are excluded: unlike NOT IN, nulls are kept."""
    return ~F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(True)


def truthy(col: Column, kind: str) -> Column:
    """Null, zero, the empty text and the empty array are false."""
    filled = {"number": col != 0, "string": col != "", "array": F.size(col) > 0, "boolean": col}[kind]
    return F.coalesce(col.isNotNull() & filled, F.lit(False))


def liability_code(score: Column, risk: Column) -> Column:
    """2 for a risk flag or score 0, 1 for score 1, else 0: the scale runs against the score's."""
    return F.when(F.coalesce(risk, F.lit(False)) | (score == 0), 2).when(score == 1, 1).otherwise(0)


def match_confidence(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.5, "medium").otherwise("low")


#: Parts of case ids by jurisdiction, the first match wins; the short name is what ids carry after truncation: fixed values.
JURISDICTION_ARMS = (("-onca-", "CA"), ("-fc-", "CA"), ("-fca-", "CA"), ("bailii", "UK"), ("courtliste", "US"), ("nzlii", "NZ"), ("austlii", "AU"))
#: The reduced ladder of the summaries: fixed values.
SUMMARY_JURISDICTIONS = (("bailii", "UK"), ("courtlistener", "US"), ("nzlii", "NZ"))
#: Names of models as shown, the first pattern that occurs wins: fixed values.
MODEL_NAMES = (
    ("gpt-5.2-concise", "GPT-5.2-Concise"),
    ("gpt-5", "GPT-5.2"),
    ("gpt-4o-mini", "GPT-4o Mini"),
    ("gpt-4o", "GPT-4o"),
    ("claude-sonnet-4\\.5", "Claude Sonnet 4.5"),
    ("claude-sonnet-4", "Claude Sonnet 4"),
    ("claude-3.5-haiku", "Claude 3.5 Haiku"),
    ("gemini-3-pro", "Gemini 3 Pro"),
    ("gemini-2.0-flash", "Gemini 2.0 Flash"),
    ("llama-4-maverick", "Llama 4 Maverick"),
    ("llama-4-scout", "Llama 4 Scout"),
    ("qwen3", "Qwen3 30B"),
    ("qwen-2.5", "Qwen 2.5 72B"),
    ("grok", "Grok 4.1"),
    ("deepseek", "DeepSeek R1"),
    ("mistral", "Mistral Large"),
)


def model_name(col: Column) -> Column:
    """A model's name as shown; others as they are."""
    return ladder(col, MODEL_NAMES, col)


def summary_jurisdiction(case_id: Column) -> Column:
    return jurisdiction(case_id, SUMMARY_JURISDICTIONS, "Unknown")


def jurisdiction(case_id: Column, arms: Sequence[tuple[str, str]] = JURISDICTION_ARMS, default: str | None = None) -> Column:
    return ladder(F.lower(case_id), arms, default, "contains")


#: Character limits of answer lengths: fixed values.
VERBOSITY = ((1000, "<1k"), (2500, "1-2.5k"), (5000, "2.5-5k"), (10000, "5-10k"))


def verbosity(length: Column) -> Column:
    return bucket(length, VERBOSITY, ">10k")


def clamp_ratio(value: Column) -> Column:
    """Scores above 1 are percentages; what is above 100 counts as 1; below 0 as 0."""
    v = F.when(value > 1, F.when(value <= 100, value / 100).otherwise(1.0)).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double")))


#: Words of the strict variant, and more words of the one that takes all else as false: fixed values.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1"), ("false", "no", "0")
MORE_TRUE_WORDS = ("established", "proven", "found")


def coerced_bool(col: Column, unknown: bool | None = None) -> Column:
    """Free text to boolean. With unknown null only plain words count; with unknown false findings count as true as well and all else is false."""
    if unknown is None:
        word = F.lower(col.cast("string"))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.lit(None).cast("boolean"))
    word = F.lower(F.trim(col.cast("string")))
    return F.when(word.isin(*TRUE_WORDS, *MORE_TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.lit(unknown))


#: Parts of texts that stand for an empty list: fixed values.
LIST_PLACEHOLDERS = ("not documented", "unknown", "none")
PLACEHOLDERS = ("n/a", "none", "not specified", "unknown", "not mentioned", "not documented", "null")


def placeholder(col: Column, words: Sequence[str] = PLACEHOLDERS, empty: bool = True) -> Column:
    """Whether a text stands for a missing value; `empty` tells whether null and "" do."""
    word = F.lower(F.trim(col))
    return F.when(col.isNull() | (word == ""), F.lit(empty)).otherwise(word.isin(*words))


def coerced_list(col: Column, parts: Sequence[str] = LIST_PLACEHOLDERS) -> Column:
    """A JSON list of texts, or a single text as a list of one; a text that holds a placeholder is the empty list; null stays null."""
    none, parsed = F.array().cast("array<string>"), F.from_json(col, "array<string>")
    out = F.when(col.isNull(), F.lit(None).cast("array<string>")).when(col.rlike(r"^\s*\[") & parsed.isNotNull(), parsed)
    return out.when(col.rlike("(?i)" + "|".join(parts)), none).otherwise(F.array(col))
