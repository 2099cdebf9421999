"""Nested cases and the fixed values of ladders and lists."""

from pyspark.sql import functions as F

from assayer.functions import ladders, text
from assayer.operators import cases


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_fixed_values(spark):
    ids = {"bailii-ewca-fca-1": "CA", "x-ONCA-2": "CA", "courtliste-9": "US", "courtlistener-9": "US", "hklii-1": None, "nzlii-fc-3": "CA"}
    for k, v in ids.items():
        assert one(spark, ladders.jurisdiction(F.lit(k))) == v
    assert one(spark, ladders.summary_jurisdiction(F.lit("courtliste-9"))) == "Unknown"
    assert one(spark, ladders.model_name(F.lit("a/gpt-4o-mini"))) == "GPT-4o Mini" and one(spark, ladders.model_name(F.lit("other"))) == "other"
    assert one(spark, text.normalized_url(F.lit("HTTPS://A.b/c/?utm_id=1&fbclid=2&b=3&click=4&a=5#x"))) == "https://a.b/c?a=5&b=3&fbclid=2"
    assert one(spark, text.normalized_title(F.lit("The Case of O'Neil & Co., by or at it"))) == "case oneil & co by it"
    assert one(spark, text.pronoun_density(F.lit("mine is I and it hers"))) == 33.33
    flags = [one(spark, ladders.coerced_bool(F.lit(x), u)) for x, u in (("breach", None), ("Found", None), ("Found", False), ("n", False), (" yes ", False))]
    assert flags == [None, None, True, False, True]
    assert one(spark, ladders.coerced_list(F.lit("None known"))) == [] and one(spark, ladders.coerced_list(F.lit(None).cast("string"))) is None


def test_nested_access(spark):
    df = spark.createDataFrame([(1, ((None,),), [("a", True, ""), ("b", True, "x"), ("c", None, "y")])], "id long, s struct<t:struct<u:int>>, p array<struct<k:string,bad:boolean,e:string>>")
    r = df.select(
        cases.at_path(df, "s.t.u", 7).alias("u"), cases.at_path(df, "s.q.u", 8).alias("q"), cases.by_id(F.col("p"), "k", "c")["e"].alias("c"),
        cases.by_id(F.col("p"), "k", "z").alias("z"), cases.first_filled(cases.flagged(F.col("p"), "bad"), "e").alias("e"),
    ).first()
    assert tuple(r) == (7, 8, "y", None, "x")
    many = spark.range(100)
    assert cases.picked(many, "id", 5).collect() == cases.picked(many.repartition(7), "id", 5).collect() != cases.picked(many, "id", 6).collect()


def test_repaired_points_have_valid_values(spark):
    df = spark.createDataFrame([([("Recovery", "diagnose", None, None), ("decision", "REFER", [("A", "x"), ("B", "y")], 4.0)],)], "p array<struct<phase_id:string,action_type:string,options:array<struct<option_id:string,description:string>>,max_score:double>>")
    a, b = df.select(cases.repaired_points(F.col("p"))).first()[0]
    assert (a["phase_id"], a["action_type"], len(a["options"]), a["max_score"]) == ("postop", "ORDER_TEST", 2, 10.0)
    assert (b["phase_id"], b["action_type"], b["options"][0]["description"], b["max_score"]) == ("decision", "REFER", "x", 4.0)


def test_replies_and_conduct(spark):
    reply = lambda q, t, m: one(spark, cases.evolved_reply(F.lit(q), F.lit(t), F.lit(m)))
    assert reply("How do you feel?", "worsening", 61) == reply("any PAIN", "worsening", 500) == cases.WORSE
    assert reply("pain", "stable", 99) is None and reply("pain", "worsening", 60) is None and reply("hello", "worsening", 99) is None
    match = lambda met, n: one(spark, cases.resembles_conduct(F.lit("I would skip the scan"), F.array(F.lit("Skip the test")), F.lit(met), F.lit(n)))
    assert match(0, 0) and match(1, 3) and not match(2, 4)
