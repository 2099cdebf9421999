import datetime

from assayer.streaming import sessions


def _events():
    t0 = datetime.datetime(2024, 1, 1)
    kinds = {"u": ["start_urgent"] + ["message"] * 9 + ["imaging"], "t": ["message", "test", "end"], "n": ["message"]}
    return [(s, k, kind, t0 + datetime.timedelta(minutes=k)) for s, ks in kinds.items() for k, kind in enumerate(ks)]


SCHEMA = "session_id string, event_id long, kind string, at timestamp"


def test_stream_equals_replay(spark, tmp_path):
    df = spark.createDataFrame(_events(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.track(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT * FROM tracked").collect()}
    assert got == {tuple(r) for r in sessions.replay(df).collect()}
    assert ("u", 8, 135, "worsening") in got and ("u", 10, 165, "stable") in got and ("t", 1, 30, "stable") in got and ("n", 0, 15, "unknown") in got


def test_windows_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame(_events(), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions.windowed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "at", "kind", "event_id")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r["kind"], r["n"]) for r in spark.sql("SELECT * FROM windows").collect()} == {("start_urgent", 1), ("message", 11), ("imaging", 1), ("test", 1), ("end", 1)}


def test_final_turns(spark):
    rows = [(1, 0, "final"), (1, 3, "my final"), (2, 0, "x"), (2, 12, "y")]
    got = {r["conv_id"]: (r["final_turn"], r["forced"]) for r in sessions.final_turns(spark.createDataFrame(rows, "conv_id long, turn long, text string"), ["final"]).collect()}
    assert got == {1: (3, False), 2: (10, True)}
