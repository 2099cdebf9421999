"""Checklist scoring, decision rules and deferral."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import mentions, terms_present, words

ITEM = "array<struct<criterion:string,weight:double,is_primary:boolean,source:string>>"


def _item(text: Column, weight: float, primary: bool, source: str) -> Column:
    return F.struct(text.alias("criterion"), F.lit(weight).alias("weight"), F.lit(primary).alias("is_primary"), F.lit(source).alias("source"))


def checklist(expected: Column, explanation: Column, endorsed: Column) -> Column:
    """The expected action (weight 2, primary), the explanation and the endorsed options (weight 1), without empty ones, first of equals kept."""
    options = F.transform(F.coalesce(endorsed, F.array().cast("array<string>")), lambda o: _item(o, 1.0, False, "option"))
    items = F.concat(F.array(_item(expected, 2.0, True, "expected_action"), _item(explanation, 1.0, False, "explanation")), options).cast(ITEM)
    return first_of_each(F.filter(items, lambda x: F.coalesce(F.trim(x["criterion"]) != "", F.lit(False))))


def first_of_each(items: Column) -> Column:
    """Items without those whose criterion, in lower case, stood before."""
    keys = F.transform(items, lambda x: F.lower(F.trim(x["criterion"])))
    return F.filter(items, lambda x, k: F.array_position(keys, F.lower(F.trim(x["criterion"]))) == k + 1)


def rubric_checklist(rubric: Column, otherwise: Column) -> Column:
    """Items of a rubric (criterion, points), none of them primary; without a rubric another checklist."""
    items = F.transform(rubric, lambda r: F.struct(r["criterion"].alias("criterion"), F.coalesce(r["points"], F.lit(1)).cast("double").alias("weight"), F.lit(False).alias("is_primary"), F.lit("rubric").alias("source")))
    return F.when(F.size(F.coalesce(rubric, F.array().cast("array<struct<criterion:string,points:int>>"))) > 0, first_of_each(items.cast(ITEM))).otherwise(otherwise)


def weighted_ratio(scored: Column) -> Column:
    """Weights met over all weights; 1 if there is none. scored: array of (weight, met)."""
    total = F.aggregate(scored, F.lit(0.0), lambda s, x: s + x["weight"])
    met = F.aggregate(scored, F.lit(0.0), lambda s, x: s + F.when(F.coalesce(x["met"], F.lit(False)), x["weight"]).otherwise(0.0))
    return F.when(total > 0, met / total).otherwise(1.0)


def thresholds(ratio: Column) -> Column:
    return F.when(ratio < 0.25, 0).when(ratio < 0.5, 1).otherwise(2)


def composite_score(ratio: Column, quality: Column) -> Column:
    """Checklist and reasoning quality, nine to one."""
    return thresholds(0.9 * ratio + 0.1 * quality)


def primary_score(scored: Column, defendant_match: Column) -> Column:
    """0 if a primary item is unmet or the answer follows the defendant, 1 if less than half of the other weight is met, else 2. No primary item counts as met."""
    met = F.forall(scored, lambda x: ~F.coalesce(x["is_primary"], F.lit(False)) | F.coalesce(x["met"], F.lit(False)))
    rest = F.filter(scored, lambda x: ~F.coalesce(x["is_primary"], F.lit(False)))
    return F.when(~met | F.coalesce(defendant_match, F.lit(False)), 0).when(weighted_ratio(rest) < 0.5, 1).otherwise(2)


def reasoning_quality(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """A flag for each group of terms, and their mean."""
    flags = [mentions(text, terms).alias(name) for name, terms in groups.items()]
    mean = sum((mentions(text, terms).cast("double") for terms in groups.values()), F.lit(0.0)) / max(1, len(groups))
    return F.struct(*flags, mean.alias("quality_score"))


def criterion_met(criterion: Column, response: Column, meta_terms: Sequence[str], indicators: Sequence[str], stop: Sequence[str], share: float = 0.4) -> Column:
    """Criteria about reasoning need three indicators; others a share of their own words (four letters or more) in the response."""
    own = F.array_distinct(F.filter(words(F.regexp_replace(criterion, r"[^A-Za-z0-9\s]", " ")), lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))
    low = F.lower(response)
    found = F.size(F.filter(own, lambda w: F.contains(low, w)))
    by_words = F.when(F.size(own) > 0, found / F.size(own) >= share).otherwise(False)
    return F.when(mentions(criterion, meta_terms), terms_present(response, indicators) >= 3).otherwise(by_words)


def zipped(items: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Items with the answer at the same place; a missing answer is not met. items: key, items; answers: key, answers (met, reason)."""
    joined = items.join(answers, key, "left")
    n = F.size("items")
    met = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get("items", k).alias("item"), F.coalesce(F.get("answers", k)["met"], F.lit(False)).alias("met")))
    return joined.select(key, F.when(n > 0, met).alias("scored"))


def matched_by_name(items: DataFrame, answers: DataFrame, key: str, prefix: int = 30) -> DataFrame:
    """key, pos, criterion, met: each item with the first answer of the same name, else the first whose name starts with the item's first characters.

    Both sides of a key are short arrays, so the match stays inside a row instead of a theta join.
    """
    joined = items.join(answers, key, "left").select(key, "answers", F.posexplode("items").alias("pos", "item"))
    clean = F.lower(F.trim(F.col("item.criterion")))
    same = F.filter("answers", lambda a: F.lower(F.trim(a["criterion"])) == clean)
    near = F.filter("answers", lambda a: F.startswith(F.lower(F.trim(a["criterion"])), F.substring(clean, 1, prefix)))
    hit = F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)))
    return joined.select(key, "pos", F.col("item.criterion").alias("criterion"), F.coalesce(hit["met"], F.lit(False)).alias("met"))


def is_primary_criterion(criterion: Column, primary: Column, source: Column, least: int = 10) -> Column:
    """Equal to a primary text, or one holds the other and is longer than `least`, or tagged as the expected action."""
    c = F.lower(F.trim(criterion))

    def same(p: Column) -> Column:
        q = F.lower(F.trim(p))
        return (q == c) | ((F.length(q) > least) & (F.length(c) > least) & (F.contains(q, c) | F.contains(c, q)))

    return F.coalesce(F.exists(primary, same), F.lit(False)) | F.coalesce(source == "expected_action", F.lit(False))


def decision_validity(text: Column, final: Column, definitive: Sequence[str], deferral: Sequence[str], urgent: Sequence[str], urgency_first: bool = False) -> Column:
    """(score_valid, deferral_reason). The two known orders of the rules differ: with urgency_first an urgent referral is looked for before a definite decision."""
    empty = F.coalesce(F.trim(final), F.lit("")) == ""
    decided, put_off, hurried = mentions(final, definitive), mentions(final, deferral), mentions(F.concat_ws(" ", text, final), urgent)
    ladder = [(hurried, True, "urgent_referral"), (decided, True, None)]
    if not urgency_first:
        ladder.reverse()
    out = F.when(empty, F.struct(F.lit(False).alias("score_valid"), F.lit("no_decision").alias("deferral_reason")))
    for test, valid, reason in ladder:
        out = out.when(test, F.struct(F.lit(valid).alias("score_valid"), F.lit(reason).cast("string").alias("deferral_reason")))
    out = out.when(put_off, F.struct(F.lit(False).alias("score_valid"), F.lit("deferred").alias("deferral_reason")))
    return out.otherwise(F.struct(F.lit(True).alias("score_valid"), F.lit(None).cast("string").alias("deferral_reason")))


def option_score(endorsed: Column, chosen_by_defendant: Column, most: Column, valid: Column) -> Column:
    """Endorsed options the full score, the defendant's a quarter, others half, both floored; an invalid choice none."""
    return F.when(~F.coalesce(valid, F.lit(False)), F.lit(0).cast("long")).when(endorsed, most.cast("long")).when(chosen_by_defendant, F.floor(most / 4)).otherwise(F.floor(most / 2))


def rank_changes(df: DataFrame, name: str, old: str, new: str) -> DataFrame:
    """name, old_rank, new_rank, change: two orders of a leaderboard side by side."""
    ranks = [F.row_number().over(Window.orderBy(F.desc(c), name)).alias(f"{k}_rank") for k, c in (("old", old), ("new", new))]
    return df.select(name, *ranks).withColumn("change", F.col("old_rank") - F.col("new_rank"))
