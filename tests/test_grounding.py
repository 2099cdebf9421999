"""Evidence against texts: the joined version and one row after the other."""

import random
import re

from assayer.operators import grounding

COMMON = ("other", "about")


def _plain(text, ref, source):
    source, words = source or "", re.findall(r"\b[a-z]{5,}\b", (text or "").lower())
    words = [w for w in words if w not in COMMON][:5]
    n = re.escape(ref or "")
    found = bool(ref) and any(re.search(p, source, re.M | re.I) for p in (rf"\[{n}\]", rf"^{n}\.", rf"¶\s*{n}", rf"para(?:graph)?\s*{n}"))
    hits = sum(w in source.lower() for w in words)
    return found, len(words), hits, found or not words or hits >= len(words) * 0.5


def test_joined_equals_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(grounding, "TERMS", 7)
    rng = random.Random(2)
    pool = "patient collapsed suddenly other about Größe naïve surgeon5 surgery theatre a an It's 12. [3] bleeding_out bleeding ÉTUDE".split()
    text = lambda n: rng.choice((" ", "\n", ", ")).join(rng.choice(pool) for _ in range(n))
    sources = [(k, rng.choice((text(30), f"[{k}] {text(4)}\n7. next ¶ 9 and Paragraph 4(b)", "", None))) for k in range(12)]
    evidence = [(k, f"e{j}", rng.choice((text(6), "", None, "suddenly suddenly nowhere1 nowhere")), rng.choice((None, "", "7", "9", "4(b)", str(k), "x\\E|.*")), "z") for k in [*range(14), None] for j in range(25)]
    got = grounding.grounded(
        spark.createDataFrame(evidence, "d long, e string, t string, ref string, row string").repartition(3), spark.createDataFrame(sources, "d long, s string"), "d", "e", "t", "ref", "s", COMMON
    )
    held = dict(sources)
    want = sorted((str(d), e, *_plain(t, r, held.get(d) if d is not None else None)) for d, e, t, r, _ in evidence)
    assert sorted((str(r["d"]), *tuple(r)[1:]) for r in got.collect()) == want
    scores = {r["d"]: (r["n"], r["passes"]) for r in grounding.grounding_scores(got, "d").collect()}
    assert all(scores[d] == (25, sum(w[5] for w in want if w[0] == str(d)) / 25 >= 0.7) for d in scores)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "d long, e string, t string, ref string")
    assert grounding.grounded(empty, spark.createDataFrame([], "d long, s string"), "d", "e", "t", "ref", "s").collect() == []


def test_texts_are_lowered_once_and_references_found_in_any_case(spark):
    evidence = spark.createDataFrame([(1, 1, "nothing", "a1"), (1, 2, "nothing", "ß\\E2"), (1, 3, "nothing", "9")], "k int, e int, text string, ref string")
    sources = spark.createDataFrame([(1, "see [A1], [ß2] and 9")], "k int, s string")
    out = grounding.grounded(evidence, sources, "k", "e", "text", "ref", "s")
    assert [r["ref_found"] for r in out.orderBy("e").collect()] == [True, True, False]
    assert "contains(lower(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
