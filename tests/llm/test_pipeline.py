"""The pipeline on a small table against a plain version of its stages."""

import numpy as np
import pytest

import corpus_pipeline
from assayer.llm import quality_rules
from assayer.llm.common import lower_ascii, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"aa": ["the", "and", "thing", "with", "house", "green"], "bb": ["der", "und", "nicht", "wieder", "haus", "blau"]}


def _rows():
    rng = np.random.default_rng(8)

    def prose(lang, n):
        return " ".join(f"{rng.choice(STEMS[lang])}{chr(97 + int(k))}{chr(97 + int(j))}" for k, j in rng.integers(0, 26, (n, 2)))

    rows = []
    for k in range(40):
        lang = ("aa", "bb")[k % 2]
        rows.append((k, prose(lang, 90), lang, f"s{k % 3}"))
    passage = prose("aa", 60)
    rows += [(100, rows[4][1], "aa", "s1"), (101, rows[5][1].replace(rows[5][1].split()[40], "changed", 1), "bb", "s1")]
    rows += [(102, f"{prose('aa', 70)} {passage} {prose('aa', 30)}", "aa", "s2"), (103, f"{prose('aa', 80)} {passage}", "aa", "s2")]
    rows += [(104, "too short", "aa", "s0"), (105, "again and again " * 40, "aa", "s0"), (106, None, "aa", "s0"), (107, "123 456 " + " ".join(str(k) for k in range(80)), None, None)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(2)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], "")))
    return out


def _ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_stages_keep_the_columns_and_reject_what_they_must(stages):
    docs, good, known, unique, cut, packed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "substring dedup", "packing"]
    assert all(s.columns == docs.columns for s in stages[:-1])
    base = set()
    for d, t, *_ in _rows():
        m = dict(zip(quality_rules.COUNTS, quality_rules.measure(t), strict=True))
        if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]:
            base.add(d)
    assert _ids(good) == base == set(range(40)) | {100, 101, 102, 103, 107}
    assert _ids(known) == base - {107}
    assert _ids(unique) == base - {107, 100, 101}
    assert _ids(cut) == _ids(unique)


def test_no_passage_is_left_twice_and_clean_texts_are_untouched(stages):
    before = {d: t for d, t, *_ in _rows()}
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    seen = {}
    for d, t in texts.items():
        w = lower_ascii(t).split()
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), d) == d
    assert [d for d in texts if texts[d] != before[d]] == [103]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_holds_every_text(stages):
    rows = stages[5].toPandas()
    assert set(rows.doc_id) == _ids(stages[4]) and (rows.groupby("sequence_id").length.sum() <= 4096).all()
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_the_stages_one_by_one(spark, stages, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(stages[5])


def test_awkward_tables_go_through(spark, tmp_path):
    good = _rows()[0][1]
    rows = [(None, good, "aa", None, 1), (1, good, "aa", "s", 1), (1, good, "aa", "s", 1), (2, None, None, None, None), (3, "", "aa", "s", 0), (4, good + " " + good.upper(), None, "s", 1)]
    for name, table in (("some", rows), ("none", [])):
        odd = spark.createDataFrame(table, SCHEMA).selectExpr("*", "'mine' AS _id", "'mine' AS key")
        odd.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (len(packed) > 0) == bool(table)
        assert {r["doc_id"] for r in packed} <= {None, 1, 4}  # empty texts go; a text that repeats itself breaks the base rule or stays
