"""Host-level quality rules.

Each document is measured once; rule failures are summed by host, a host's failure rate is shrunk towards the corpus
rate with a beta prior fitted to all hosts by the method of moments, and the hosts' verdicts are joined back.

A document that fails a base rule goes. In a rejected host a document that breaks any of the softer rules goes as well,
so that clean pages of a bad host stay. Null or empty text has no words and fails the base rule; a null host and an empty
one are the same host; repeated rows are measured and returned each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import free_name, map_lists, read, release, ship, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_WORDS = 20
MAX_DUP_LINE_PERCENT = 30
MIN_MEAN_CHARS, MAX_MEAN_CHARS = 2, 12
MAX_HOST_RATE = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    a = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    pair = a[:-1] * size + a[1:]
    if size > 2_000_000:  # else three of them fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= hit
    return int(mark.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts in COUNTS of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = 0
    for x in lines:
        if x in seen:
            dup += 1
        else:
            seen.add(x)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    return len(words), chars, sum(map((text or "").count, SYMBOLS)), len(lines), dup, repeated_words(words)


def _measure_batches(batches: Iterator[dict]) -> Iterator[dict]:
    for x in batches:
        out = np.array([measure(t) for t in x.pop("text")], dtype=np.int64).reshape(-1, len(COUNTS))
        yield x | dict(zip(COUNTS, out.T, strict=True))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host and COUNTS of each row of docs (doc_id, text, source)."""
    picked = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("host"), "text")
    return map_lists(picked, _measure_batches, MEASURED)


def with_rules(counts: DataFrame) -> DataFrame:
    """Adds base_failed, soft_failed and failed; all rules are integer comparisons."""
    c = F.col
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    soft = (
        (100 * c("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * c("n_words"))
        | (100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"))
        | (c("word_chars") < MIN_MEAN_CHARS * c("n_words"))
        | (c("word_chars") > MAX_MEAN_CHARS * c("n_words"))
    )
    return counts.withColumns({"base_failed": base, "soft_failed": soft, "failed": base | soft})


def host_verdicts(ruled: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, docs, fails, rate (shrunk), host_rejected. Only six sums over the hosts come to the driver."""
    hosts = ruled.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails"))
    n, f = F.col("docs"), F.col("fails")
    s = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("q")).first()
    alpha, beta = beta_prior(s["h"], s["n"] or 0, s["f"] or 0, s["q"] or 0.0)
    rate = (f + F.lit(alpha)) / (n + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("host_rejected", rate > max_rate)


def beta_prior(h: int, n: int, f: int, q: float) -> tuple[float, float]:
    """Method of moments: h hosts, n documents, f failures, q the sum of failures squared over documents of each host."""
    if not n or f in (0, n):
        return (1.0 if f else 0.0) + 1e-3, (0.0 if f else 1.0) + 1e-3
    mean = f / n
    between = (q / n - mean * mean) - mean * (1 - mean) * h / n
    strength = min(1e6, max(1.0, mean * (1 - mean) / between - 1)) if between > 1e-12 else 1e6
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base_failed and kept of each document.

    The verdict table has a row per host; Spark broadcasts it if its measured size allows, else it splits hot hosts of the
    sort-merge join.
    """
    ruled = written(with_rules(measured(docs)))
    bad = host_verdicts(ruled, max_rate).where("host_rejected").select("host", "host_rejected")
    verdict = F.coalesce("host_rejected", F.lit(False)) & F.col("soft_failed")
    return ruled.join(bad, "host", "left").withColumn("kept", ~F.col("base_failed") & ~verdict)


def keep(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that stay, with their columns.

    Documents are measured twice, for the hosts' rates and to filter, because texts are wider than their counts: no text is
    shuffled or stored.
    """
    ship(docs.sparkSession)
    bad = written(host_verdicts(with_rules(measured(docs)), max_rate).where("host_rejected").select("host", "host_rejected"))
    flags = F.pandas_udf(_flags, "struct<base_failed:boolean,soft_failed:boolean>")
    host, failed, rejected = free_name(docs, "_host"), free_name(docs, "_failed"), free_name(docs, "_rejected")
    marked = docs.withColumns({host: F.coalesce("source", F.lit("")), failed: flags(F.col("text"))}).where(~F.col(failed)["base_failed"])
    if not bad.isEmpty():
        verdicts = bad.select(F.col("host").alias(host), F.col("host_rejected").alias(rejected))
        marked = marked.join(verdicts, host, "left").where(~(F.coalesce(rejected, F.lit(False)) & F.col(failed)["soft_failed"]))
    return marked.select(*docs.columns)


def _flags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield _flagged(texts)
    release()


def _flagged(texts: pd.Series) -> pd.DataFrame:
    m = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
    words, chars, symbols, lines, dup, repeat = m.T
    base = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
    soft = (100 * symbols > MAX_SYMBOLS_PER_100_WORDS * words) | (100 * dup > MAX_DUP_LINE_PERCENT * lines)
    soft |= (chars < MIN_MEAN_CHARS * words) | (chars > MAX_MEAN_CHARS * words)
    return pd.DataFrame({"base_failed": base, "soft_failed": soft})


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words
  FROM d LEFT JOIN marked USING (doc_id)),
r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines
         OR word_chars < {MIN_MEAN_CHARS} * n_words OR word_chars > {MAX_MEAN_CHARS} * n_words AS soft_failed FROM m),
h AS (SELECT host, count(*)::DOUBLE AS docs, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS fails FROM r GROUP BY host),
s AS (SELECT count(*) AS h, sum(docs) AS n, sum(fails) AS f, sum(fails * fails / docs) AS q FROM h),
p AS (
  SELECT f / n AS mean, (q / n - (f / n) * (f / n)) - (f / n) * (1 - f / n) * h / n AS between_hosts FROM s),
k AS (
  SELECT mean, CASE WHEN between_hosts > 1e-12
    THEN least(1e6, greatest(1.0, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS strength FROM p),
v AS (SELECT host, (fails + mean * strength) / (docs + strength) > {MAX_HOST_RATE} AS rejected FROM h, k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (rejected AND soft_failed) AS kept
FROM r JOIN v USING (host)
"""
