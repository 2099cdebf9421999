import math

import pytest
from pyspark.sql import functions as F

from assayer.functions import ladders, tails
from assayer.functions import text as T
from assayer.functions.rules import Rules, assembled, classified_by_table
from assayer.operators import cost, documents, graph, qa, runs, scoring, similarity, stats, votes


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tails_at_known_values():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(5.991464547, 2) == pytest.approx(0.05)
    assert tails.chi2_upper(0.5, 3) == pytest.approx(0.9188914)
    assert [tails.p_text(p) for p in (0.0001, 0.0042, 0.25)] == ["p<.001", "p=0.004", "p=0.25"]


def test_null_safe_exclusion_and_ladders(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert df.where(ladders.excluded(F.col("k"), ["a"])).count() == 2
    assert one(spark, ladders.ladder(F.lit("gpt-mini"), [("mini", "small"), ("gpt", "large")], "other")) == "small"
    assert one(spark, ladders.recode(F.lit("z"), {"a": "b"})) == "z"
    assert one(spark, ladders.titled(F.lit("a_bc"))) == "A Bc"
    assert [one(spark, ladders.clamp_ratio(F.lit(v))) for v in (0.4, 55.0, 300.0, -1.0)] == [0.4, 0.55, 1.0, 0.0]
    assert [one(spark, ladders.coerced_bool(F.lit(v), u)) for v, u in (("Yes", None), ("no", None), ("?", None), ("?", False))] == [True, False, None, False]
    assert one(spark, ladders.coerced_list(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, ladders.coerced_list(F.lit("none"))) == [] and one(spark, ladders.coerced_list(F.lit("x"))) == ["x"]
    assert [one(spark, ladders.match_confidence(F.lit(v))) for v in (0.71, 0.7, 0.5)] == ["high", "medium", "low"]
    assert one(spark, ladders.truthy(F.lit(0), "number")) is False and one(spark, ladders.placeholder(F.lit(""), empty=False)) is False


def test_text_functions(spark):
    assert one(spark, T.without_thoughts(F.lit("<think>a\nb</think> c"))) == "c"
    assert one(spark, T.json_list(F.lit('x [{"a":1}] y'), "array<struct<a:int>>"))[0]["a"] == 1
    assert one(spark, T.json_list(F.lit("none"), "array<int>")) is None
    assert one(spark, T.unfenced(F.lit("```json\n[1]\n```"))).strip() == "[1]"
    assert one(spark, T.normalized_url(F.lit("Example.org/A/?b=2&utm_source=x&a=1#f"))) == "https://example.org/a?a=1&b=2"
    assert str(one(spark, T.any_date(F.lit("3 March 2020")))) == "2020-03-03" and one(spark, T.any_date(F.lit("soon"))) is None
    assert one(spark, T.sentences(F.lit("This is one. And this two! no split here"))) == ["This is one", "And this two! no split here"]
    assert one(spark, T.case_key(F.lit("courtlistener"), F.lit("A v. B"))) == "courtliste-a-v-b"
    assert one(spark, T.context_of(F.lit("abc term xyz"), "term", 3)) == "bc term xy"
    assert one(spark, T.mentions(F.lit("status"), ["stat"])) and not one(spark, T.mentions(F.lit("status"), ["stat"], True))


def test_rules(spark, tmp_path):
    assert Rules.load(str(tmp_path / "none.yaml"), "type") == Rules()
    (tmp_path / "r.yaml").write_text("rules:\n- {pattern: 'a+', type: A}\n- {pattern: b, type: B}\ndefault: other\npriority: [B]\n")
    r = Rules.load(str(tmp_path / "r.yaml"), "type")
    assert one(spark, r.first(F.lit("baa"))) == "A" and one(spark, r.prioritized(F.lit("baa"))) == "B" and one(spark, r.first(F.lit("zz"))) == "other"
    assert one(spark, assembled(F.lit("a"), F.lit(""), F.lit("b"))) == "a b" and one(spark, assembled(F.lit(None), F.lit("b"), keep_first=True)) == " b"
    texts = spark.createDataFrame([(1, "xb"), (2, "q")], "k int, t string")
    table = spark.createDataFrame([(2, "B", "b"), (1, "X", "^x")], "ordinal int, label string, pattern string")
    assert {x["k"]: x["label"] for x in classified_by_table(texts, table, "t", "k").collect()} == {1: "X", 2: None}


def test_votes(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, 0, 0), (0, None, 1), (1, 1, 1)], "a int, b int, c int")
    got = df.select(votes.majority("abc").alias("m"), votes.majority("abc", "median").alias("d"), votes.first_mode("abc").alias("f")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 0), (1, 1, 1), (0, 0, 0), (None, None, 0), (1, 1, 1)]
    d = {r["dissenter"]: (r["votes"], round(r["proportion"], 4)) for r in votes.minority_votes(df, ["a", "b", "c"]).collect()}
    assert d == {"c": (1, 0.3333), "a": (1, 0.3333)}


def test_bootstrap_brackets_kappa(spark):
    df = spark.range(600).select(F.col("id"), (F.col("id") % 3).alias("x"), F.when(F.col("id") % 5 == 0, (F.col("id") + 1) % 3).otherwise(F.col("id") % 3).alias("y"))
    r = votes.bootstrap_kappa(df, "x", "y", "id", samples=60).first()
    assert r["low"] < r["kappa"] < r["high"] and r["high"] - r["low"] < 0.2 and abs(r["kappa"] - 0.7) < 0.01


def test_statistics_of_ties_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 3.0), ("b", 2.0), ("b", None)], "g string, v double")
    ranks = {(r["g"], r["v"]): r["rank"] for r in stats.with_mid_ranks(df, "v").collect()}
    assert ranks == {("a", 1.0): 1.0, ("a", 2.0): 3.0, ("b", 3.0): 5.0, ("b", 2.0): 3.0, ("b", None): None}
    w = stats.wilcoxon_pairs(df, "v", "g").first()
    assert (w["n1"], w["n2"], w["w"]) == (3, 2, 1.0) and 0 < w["p"] <= 1
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["v_scaled"] for r in runs.min_max(same, ["v"]).collect()] == [None, None]
    r = stats.with_correlation_p(stats.pearson(spark.range(50).selectExpr("double(id) AS x", "double(id * id) AS y"), "x", "y")).first()
    assert r["low"] < r["r"] < r["high"] and r["p"] < 1e-6


def test_price_fallback_and_zero_costs(spark):
    prices = spark.createDataFrame([("c", "B", 1, 5.0), ("c", "A", 2, 7.0), ("c", "B", 3, 6.0), ("", "A", 4, 1.0)], "code string, plan string, load_ordinal long, amount double")
    asked = spark.createDataFrame([(1, "c", "A"), (2, "c", "Z"), (3, "x", "A"), (4, "c", None)], "k int, code string, plan string")
    got = {r["k"]: (r["price_plan"], r["amount"]) for r in cost.priced(asked, prices).collect()}
    assert got == {1: ("A", 7.0), 2: ("B", 6.0), 3: (None, None), 4: ("B", 6.0)}
    zero = spark.createDataFrame([(0.0,), (None,)], "c double")
    assert zero.agg(cost.nonzero_sum("c").alias("x")).first()["x"] is None


def test_similarity(spark):
    assert one(spark, similarity.adjacent_coherence(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))))) == 0.5
    assert len(one(spark, similarity.hashed_embedding(F.lit("a b"), 16))) == 16


def test_graph_and_queue(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5)], "src long, dst long")
    got = {r["node"]: (r["depth"], r["priority"]) for r in graph.expanded(spark.createDataFrame([(1,)], "node long"), edges, 2).collect()}
    assert got == {2: (1, 0.8), 3: (1, 0.8), 4: (2, 0.7)}
    cand = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "id int, url string")
    have = spark.createDataFrame([(9, "v")], "id int, url string")
    assert [tuple(r) for r in graph.new_rows(cand, have, ["id", "url"]).collect()] == [(1, "u")]


def test_html_blocks_nested_and_broken():
    got = documents.html_blocks("<div>a<p>b &amp; c<p>d</div><script>x</script><p>tail")
    assert got == [("p", "b & c"), ("p", "d"), ("div", "ab & cd"), ("p", "tail")] and documents.html_blocks(None) == []


def test_segments_and_sections(spark):
    assert documents.packed([(0, 5), (1, 5), (2, 5)], 10, 5) == [(0, 0, 1, 10, False), (1, 1, 2, 10, True)]
    assert documents.packed([(0, 50), (1, 1)], 10, 5) == [(0, 0, 0, 50, False), (1, 1, 1, 1, False)]
    rows = [(1, k, t, k == 2) for k, t in enumerate(["Introduction", "some plain words here that go on.", "FACTS", "more plain words follow it."])]
    df = spark.createDataFrame(rows, "d int, pos int, text string, pri boolean").withColumn("tok", F.lit(4))
    assert [r["section"] for r in documents.with_sections(df, "d").orderBy("pos").collect()] == ["Introduction", "Introduction", "FACTS", "FACTS"]
    seg = documents.segments(df, "d", "pos", "tok", 8, 0, "pri").orderBy("segment_id").collect()
    assert [(r["segment_id"], r["first_pos"], r["last_pos"]) for r in seg] == [(0, 2, 2), (1, 0, 1), (2, 3, 3)]
    got = documents.evidence_context(df, "d", "pos", "text", "tok", ["facts"], 20).collect()
    assert {r["pos"]: r["reason"] for r in got} == {3: "last", 2: "term", 0: "first"}


def test_checklists_and_scores(spark):
    items = one(spark, scoring.checklist(F.lit("Do it"), F.lit(""), F.array(F.lit("do it"), F.lit("Other"))))
    assert [(i["criterion"], i["weight"], i["is_primary"]) for i in items] == [("Do it", 2.0, True), ("Other", 1.0, False)]
    scored = F.array(F.struct(F.lit(2.0).alias("weight"), F.lit(True).alias("met"), F.lit(True).alias("is_primary")), F.struct(F.lit(1.0).alias("weight"), F.lit(False).alias("met"), F.lit(False).alias("is_primary")))
    assert one(spark, F.round(scoring.weighted_ratio(scored), 4)) == 0.6667 and one(spark, scoring.primary_score(scored, F.lit(False))) == 1
    assert one(spark, scoring.primary_score(scored, F.lit(True))) == 0 and one(spark, scoring.weighted_ratio(F.filter(scored, lambda x: F.lit(False)))) == 1.0
    a = spark.createDataFrame([(1, [("Order an ECG now please and do not wait any longer",), ("b",)])], "k int, items array<struct<criterion:string>>")
    b = spark.createDataFrame([(1, [("order an ecg now please and do something",  False), ("Order an ECG now please and do not wait", True)])], "k int, answers array<struct<criterion:string,met:boolean>>")
    assert [r["met"] for r in scoring.matched_by_name(a, b, "k").orderBy("pos").collect()] == [False, False]
    first = scoring.decision_validity(F.lit("x"), F.lit("go to emergency, I diagnose"), ["diagnose"], ["later"], ["emergency"])
    second = scoring.decision_validity(F.lit("x"), F.lit("go to emergency, I diagnose"), ["diagnose"], ["later"], ["emergency"], urgency_first=True)
    assert one(spark, first)["deferral_reason"] is None and one(spark, second)["deferral_reason"] == "urgent_referral"
    assert one(spark, scoring.is_primary_criterion(F.lit("perform the scan today"), F.array(F.lit("Perform the scan")), F.lit("rubric"))) is True


CASE = """case_id string, court string, url string, summary string, evidence_index array<struct<evidence_id:string>>, references array<string>,
timeline array<string>, taxonomy array<string>,
decision_points array<struct<decision_id:string,options:array<string>,actual_action:string,expected_action:string,is_malpractice_point:boolean>>"""


def test_validator_by_mutation(spark):
    point = ("d1", ["a", "b"], "x", "y", True)
    good = {"case_id": "c", "court": "k", "url": "u", "summary": "s", "evidence_index": [("E1",)], "references": ["E1"], "timeline": ["t"], "taxonomy": ["z"], "decision_points": [point, ("d2", ["a", "b"], "x", "y", False)]}
    changes = {
        None: {}, "MISSING_REQUIRED": {"court": ""}, "NO_EVIDENCE": {"evidence_index": [], "references": []}, "ORPHAN_EVIDENCE_REF": {"references": ["E1", "E9"]},
        "LOW_EVIDENCE_COVERAGE": {"references": []}, "INSUFFICIENT_DECISION_POINTS": {"decision_points": [point]}, "DUPLICATE_ID": {"decision_points": [point, point]},
        "INSUFFICIENT_OPTIONS": {"decision_points": [point, ("d2", ["a"], "x", "y", False)]}, "MISSING_ACTUAL_ACTION": {"decision_points": [point, ("d2", ["a", "b"], None, "y", False)]},
        "MISSING_EXPECTED_ACTION": {"decision_points": [point, ("d2", ["a", "b"], "x", "", False)]}, "NO_MALPRACTICE_POINT": {"decision_points": [("d1", ["a", "b"], "x", "y", False), ("d2", ["a", "b"], "x", "y", None)]},
        "EMPTY_TIMELINE": {"timeline": None}, "INCOMPLETE_SUMMARY": {"summary": None}, "MISSING_TAXONOMY": {"taxonomy": []},
    }
    names = ["case_id", "court", "url", "summary", "evidence_index", "references", "timeline", "taxonomy", "decision_points"]
    df = spark.createDataFrame([tuple({**good, **c}[n] for n in names) for c in changes.values()], CASE)
    found = [[i["code"] for i in r["x"]] for r in df.select(qa.case_issues().alias("x")).collect()]
    for (code, _), codes in zip(changes.items(), found, strict=True):
        assert codes == ([code] if code else []), (code, codes)


def test_quality_and_grades(spark):
    assert one(spark, qa.grade(F.lit(0.66))) == "good" and one(spark, qa.grade(F.lit(0.1))) == "unsuitable" and one(spark, qa.grade(F.lit(0.55))) == "marginal"
    df = spark.createDataFrame([("excellent",), ("marginal",), ("poor",)], "g string")
    assert qa.at_least(df, "g", "marginal").count() == 2
    assert one(spark, qa.verdict_in_tail(F.lit("dismissed " * 10 + "negligent found"), "negligent", "dismissed", 0.14)) == "LIABLE"
    assert one(spark, qa.grounded(F.lit("patient collapsed suddenly"), F.lit("the patient collapsed"), [])) is True
    assert math.isclose(stats.half_width(103), 0.1959963984540054)


def test_norm_of_a_vector_is_computed_once_not_for_each_element(spark):
    from assayer.operators.similarity import normalized
    from assayer.operators.vector_index import _units

    df = normalized(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "k int, v array<double>"), "v")
    assert [r["unit"] for r in df.orderBy("k").collect()] == [[0.6, 0.8], None, None, None]
    plan = _units(df, "k", "v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "/ sqrt(" not in plan
