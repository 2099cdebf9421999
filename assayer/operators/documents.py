"""Ordered documents: paragraphs, sections, segments and evidence selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.folds import Packing, Selection, folded
from assayer.shipping import ship

BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "div", "blockquote", "td", "article", "section")
SILENT_TAGS = ("script", "style", "head", "noscript")
HEADINGS = r"(?i)^\s*(?:[ivx\d]+[.)]\s*)?(?:introduction|background|facts?|evidence|issues?|discussion|analysis|findings|conclusions?|judge?ment|orders?|damages)\s*:?\s*$"


class _Blocks(HTMLParser):
    """Texts of block elements in document order of their ends; a block inside another also counts for the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.silent = 0
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in BLOCK_TAGS:
            if tag in ("p", "li", "td") and self.open and self.open[-1][0] == tag:  # these end where the next one starts
                self.handle_endtag(tag)
            self.open.append((tag, []))
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif any(t == tag for t, _ in self.open):
            while self.open:
                kind, parts = self.open.pop()
                text = " ".join("".join(parts).split())
                if text:
                    self.found.append((kind, text))
                if kind == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for _, parts in self.open:
                parts.append(data)


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    for tag in [t for t, _ in parser.open][::-1]:
        parser.handle_endtag(tag)
    return parser.found


def html_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, tag, text of each block element of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, pos, tag, text) for k, h in zip(pdf[key], pdf[html], strict=True) for pos, (tag, text) in enumerate(html_blocks(h))]
            yield pd.DataFrame(rows, columns=[key, "pos", "tag", "text"])

    ship(pages.sparkSession)
    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, pos int, tag string, text string")


def text_paragraphs(docs: DataFrame, key: str, text: str, pattern: str = r"\n\s*\n") -> DataFrame:
    """key, pos, text of the parts between blank lines."""
    parts = docs.select(key, F.posexplode(F.split(text, pattern)).alias("pos", "text"))
    return parts.withColumn("text", F.trim("text")).where("text != ''")


def numbered(text: Column) -> tuple[Column, Column]:
    """A paragraph's leading number, null if there is none, and the text without it."""
    pattern = r"^\s*[\[(]?(\d+)[\])]?[.)]?\s+"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.regexp_replace(text, pattern, "")


def is_heading(text: Column, pattern: str = HEADINGS) -> Column:
    """A section title, a short line of capitals, or a few capitalised words."""
    n = F.size(F.split(F.trim(text), r"\s+"))
    capitals = (text == F.upper(text)) & text.rlike("[A-Z]") & (n <= 10) & (F.length(text) < 100)
    title = (text == F.initcap(text)) & text.rlike("^[A-Z]") & (n <= 6) & ~text.rlike(r"[.!?]\s*$")
    return (F.length(text) <= 200) & (text.rlike(pattern) | capitals | title)


def with_sections(paragraphs: DataFrame, key: str, pos: str = "pos", text: str = "text") -> DataFrame:
    """Adds is_heading and section: the last heading so far within the document."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = is_heading(F.col(text))
    return paragraphs.withColumn("is_heading", head).withColumn("section", F.last(F.when(F.col("is_heading"), F.col(text)), ignorenulls=True).over(w))


SEGMENT = "segment_id int, first_pos int, last_pos int, n_tokens int, overlaps boolean"


def packed(items: list[tuple[int, int]], budget: int, overlap: int) -> list[tuple[int, int, int, int, bool]]:
    """Segments over (pos, tokens): filled up to the budget, each starting with the last items of the one before that fit the overlap."""
    out, now, carried = [], [], 0
    for pos, tokens in items:
        if len(now) > carried and sum(t for _, t in now) + tokens > budget:
            out.append((len(out), now[0][0], now[-1][0], sum(t for _, t in now), carried > 0))
            tail: list[tuple[int, int]] = []
            for p, t in reversed(now):
                if sum(x for _, x in tail) + t > overlap:
                    break
                tail.insert(0, (p, t))
            if sum(t for _, t in tail) + tokens > budget:
                tail = []
            now, carried = tail, len(tail)
        now.append((pos, tokens))
    if len(now) > carried:
        out.append((len(out), now[0][0], now[-1][0], sum(t for _, t in now), carried > 0))
    return out


def segments(paragraphs: DataFrame, key: str, pos: str, tokens: str, budget: int = 12000, overlap: int = 500, priority: str | None = None) -> DataFrame:
    """key and SEGMENT, as packed has them, folded over the rows of each document as they pass.

    With priority (a boolean column) those paragraphs are packed first and the others after them, ids running on. Null tokens
    are none; paragraphs at the same position go by their tokens.
    """
    group = F.lit(0) if priority is None else F.when(F.coalesce(F.col(priority), F.lit(False)), 0).otherwise(1)
    columns = {"group": group, "pos": F.col(pos).cast("int"), "tokens": F.col(tokens).cast("int")}
    return folded(paragraphs, key, [group, F.col(pos)], columns, lambda: Packing(budget, overlap), SEGMENT)


def evidence_context(
    paragraphs: DataFrame, key: str, pos: str, text: str, tokens: str, terms: Sequence[str], budget: int, parts: Sequence[float] = (0.30, 0.25, 0.25, 0.15), last: int = 20, first: int = 15
) -> DataFrame:
    """key, pos, reason of the paragraphs that fit: the last ones, those with terms, the first ones, then the others.

    Each kind takes paragraphs in its order (the last ones from the end) while its share of the budget lasts, leaving out what
    does not fit; a paragraph is taken once.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(low, F.lit(term.lower()))
    rooms = tuple(int(budget * share) for share in parts)
    columns = {"pos": F.col(pos).cast("int"), "tokens": F.col(tokens).cast("int"), "hit": hit}
    return folded(paragraphs, key, [F.col(pos)], columns, lambda: Selection(rooms, last, first), "pos int, reason string")


def with_evidence_ids(paragraphs: DataFrame, key: str, pos: str = "pos", text: str = "text", most: int = 500) -> DataFrame:
    """Adds evidence_id, E001 and so on within a document, and the start of the text that is cited."""
    w = Window.partitionBy(key).orderBy(pos)
    return paragraphs.withColumns({"evidence_id": F.format_string("E%03d", F.row_number().over(w)), "excerpt": F.substring(text, 1, most)})


def merged_segments(parts: DataFrame, key: str, order: str, first: Sequence[str], last: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row for each key: first and last non-null values in order, and lists joined in order without repeats."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    for c in lists:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.array().cast(dict(parts.dtypes)[c])).alias("v"))))
        aggs.append(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["v"]))).alias(c))
    return parts.groupBy(key).agg(*aggs)
