"""License scans by an exact set-similarity join of text blocks with license templates.

Tokens are ordered by their frequency in the whole corpus, the rarest first. A block is a run of LINES lines (all lines if there
are fewer), so that a notice wrapped over lines stands in one; runs of fewer lines have no token that these lack. A block
contains a template if it has at least `percent` of the template's distinct tokens. Such a block must have one of the template's first
size - need + 1 tokens (prefix filter), at least `need` template tokens at all (length filter), and enough tokens left on
both sides after their first common token (positional filter). Blocks that pass are joined with the templates by token and
verified on their full token sets, so the result is exact.

A null text is an empty one: no words, no labels, score 0. Repeated rows get equal values; other columns are ignored; an
empty table gives no row. Each worker holds the templates' tokens, which are a parameter; the tables that join blocks with
templates are broadcast up to BROADCAST_ROWS rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_lists, read, written

PERCENT = 80
LINES = 4
#: Rows of template tokens up to which they are broadcast; a row takes about 60 bytes.
BROADCAST_ROWS = 100_000
#: Phrases and their labels: fixed values.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as licensors ask for them to be written, by the label that a block containing one gets.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "cc0-dedication": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}
_OTHER = bytes(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A))
_SPACED = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters."""
    return text.encode("utf-8").lower().translate(_SPACED).split()


def places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """Word positions and labels of all places where the words of a phrase stand consecutively."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        sought = f" {phrase} ".encode()
        at = line.find(sought)
        while at >= 0:
            out.append((line.count(b" ", 0, at + 1) - 1, label))
            at = line.find(sought, at + 1)
    return out


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of each token of the vocabulary in all texts; the result is as large as the vocabulary."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for x in batches:
            for text in x["text"]:
                if text:
                    seen.update(filter(vocabulary.__contains__, tokens(text)))
        yield {"token": list(seen), "n": list(seen.values())}

    found = map_lists(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in found}


class Index:
    """Templates as sets of token numbers; a token's number is its place in the global order, the rarest first."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], percent: int):
        sets = {label: set(tokens(text)) for label, text in templates.items()}
        order = sorted(set().union(*sets.values()), key=lambda t: (counts.get(t, 0), t))
        self.number = {t: k for k, t in enumerate(order)}
        self.rows = []
        for label, s in sets.items():
            ids = sorted(self.number[t] for t in s)
            need = -(-percent * len(ids) // 100)
            self.rows.append((label, ids, need))
        self.prefix = {t for _, ids, need in self.rows for t in ids[: len(ids) - need + 1]}
        self.least = min((need for _, _, need in self.rows), default=0)

    def blocks(self, text: str, lines: int) -> list[list[int]]:
        """The template tokens, in global order, of each block that may hold a template."""
        number = self.number
        of_line = [{number[w] for w in tokens(line) if w in number} for line in text.split("\n")]
        out = set()
        for k in range(max(1, len(of_line) - lines + 1)):
            ids = set().union(*of_line[k : k + lines])
            if len(ids) >= self.least and not ids.isdisjoint(self.prefix):
                out.add(tuple(sorted(ids)))
        return [list(x) for x in sorted(out)]


SCANNED = "doc_id long, row_key long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<array<int>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT, lines: int = LINES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    vocabulary = {t for text in templates.values() for t in tokens(text)}
    index = Index(templates, token_counts(docs, vocabulary), percent)

    names = [f.split()[0] for f in SCANNED.split(", ")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            rows = []
            for doc, text in zip(x["doc_id"], x["text"], strict=True):
                text = text or ""
                words = tokens(text)
                found = places(words, PHRASES)
                at = [k for k, _ in found]
                blocks = []
                if not index.prefix.isdisjoint(index.number[w] for w in words if w in index.number):
                    blocks = index.blocks(text, lines)
                key = xxhash.xxh3_64_intdigest(f"{doc} {text}") - 2**63
                rows.append((doc, key, len(words), len(found), min(at, default=None), max(at, default=None), sorted({x for _, x in found}), blocks))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    base = written(map_lists(docs, run, SCANNED))
    prefixes = [(label, len(ids), need, t, k) for label, ids, need in index.rows for k, t in enumerate(ids[: len(ids) - need + 1])]
    small = sum(len(ids) for _, ids, _ in index.rows) <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda table: table
    table = sent(spark.createDataFrame(prefixes, "label string, size int, need int, token int, place int"))
    whole = sent(spark.createDataFrame([(label, ids) for label, ids, _ in index.rows], "label string, template array<int>"))
    blocks = base.where(F.size("blocks") > 0).select("row_key", F.explode(F.array_distinct("blocks")).alias("block"))
    met = blocks.select("row_key", "block", F.posexplode("block").alias("at", "token")).join(table, "token")
    left = F.least(F.col("size") - F.col("place"), F.size("block") - F.col("at"))
    first = met.where(F.size("block") >= F.col("need")).groupBy("row_key", "block", "label", "size", "need").agg(F.min_by(left, "at").alias("left"))
    overlap = F.size(F.array_intersect("block", "template"))
    passed = first.where("left >= need").join(whole, "label").withColumn("overlap", overlap).where("overlap >= need")
    labels = passed.groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("best"))
    out = base.drop("blocks").join(labels, "row_key", "left")
    everything = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _values() -> str:
    rows = []
    for label, text in TEMPLATES.items():
        distinct = sorted({t.decode() for t in tokens(text)})
        rows += [f"('{label}', '{t}', {len(distinct)}, {-(-PERCENT * len(distinct) // 100)})" for t in distinct]
    return ", ".join(rows)


def _phrases() -> str:
    return ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM documents),
p(phrase, k, label) AS (VALUES {_phrases()}),
found AS (
  SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p
  ON list_aggregate(w[i : i + k - 1], 'string_agg', ' ') = phrase),
b AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base
  FROM found GROUP BY doc_id),
tpl(label, token, size, need) AS (VALUES {_values()}),
l AS (SELECT doc_id, r, s[k] AS line, k FROM (
  SELECT doc_id, r, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, row_number() OVER () AS r, string_split(t, chr(10)) AS s FROM d))),
one AS (SELECT DISTINCT doc_id, r, k, unnest(regexp_extract_all({_LOWER.format('line')}, '{_WORD}')) AS token FROM l),
lt AS (SELECT DISTINCT doc_id, r * 100000000 + k - v AS k, token FROM one SEMI JOIN tpl USING (token), (VALUES {", ".join(f"({x})" for x in range(LINES))}) w(v) WHERE k - v >= 1),
c AS (SELECT doc_id, k, label, size, count(*) AS o FROM lt JOIN tpl USING (token) GROUP BY doc_id, k, label, size, need HAVING count(*) >= need),
m AS (SELECT doc_id, list(DISTINCT label) AS more, max(o / size) AS best FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, array_to_string(coalesce(base, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
