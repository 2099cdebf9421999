"""Rule classifiers over a rule table: ordinal, label, pattern, and priorities. Rules are data, compiled to one expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Ordered (pattern, label) rules, the label when none matches, and labels that win over other matches."""

    rules: tuple[tuple[str, str], ...] = ()
    default: str | None = None
    priority: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str, kind: str) -> Rules:
        """From YAML: rules (pattern and `kind`), default, priority. A missing file is no rules."""
        import yaml

        if not Path(path).exists():
            return cls()
        data = yaml.safe_load(Path(path).read_text()) or {}
        rules = tuple((r["pattern"], r[kind]) for r in data.get("rules", []))
        return cls(rules, data.get("default"), tuple(data.get("priority", [])))

    def first(self, text: Column) -> Column:
        """The label of the first rule that matches."""
        hits = [F.when(text.rlike(f"(?i){p}"), label) for p, label in self.rules]
        return F.coalesce(*hits, F.lit(self.default)) if hits else F.lit(self.default)

    def matches(self, text: Column) -> Column:
        """Labels of all rules that match, in order, each once."""
        if not self.rules:
            return F.array().cast("array<string>")
        return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), label) for p, label in self.rules])))

    def prioritized(self, text: Column) -> Column:
        """Of all matches the first in the priority list; without one the match of the least ordinal."""
        found = self.matches(text)
        top = F.get(F.filter(F.array(*[F.lit(x) for x in self.priority]).cast("array<string>"), lambda x: F.array_contains(found, x)), F.lit(0))
        return F.coalesce(top, F.get(found, F.lit(0)), F.lit(self.default))


def classified_by_table(texts: DataFrame, rules: DataFrame, text: str, key: str) -> DataFrame:
    """key, label: the first rule of a large rule table (ordinal, label, pattern) that matches; the table is kept in arrays, so that nothing is cross-joined row by row."""
    ordered = rules.agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "pattern"))).alias("_rules"))
    joined = texts.join(F.broadcast(ordered))
    hit = F.get(F.filter("_rules", lambda r: F.expr("true") & F.call_function("rlike", F.col(text), r["pattern"])), F.lit(0))
    return joined.select(key, hit["label"].alias("label"))


def assembled(*parts: Column, keep_first: bool = False) -> Column:
    """Texts joined by blanks without the empty ones; keep_first keeps an empty leading part."""
    used = [F.nullif(p, F.lit("")) for p in parts]
    if keep_first and parts:
        used[0] = F.coalesce(parts[0], F.lit(""))
    return F.concat_ws(" ", *used)
