"""Sessions as keyed state, and event-time windows.

Batch and streaming share the rules: a session's clock moves by a fixed step with each message, an urgent session without an
imaging order worsens once its clock passes a limit, and stays stable once a test was ordered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.shipping import ship

STEP_MINUTES = 15
LIMIT_MINUTES = 120
STATE = "elapsed int, tests int, imaging int, urgent boolean"
REPLY = "session_id string, event_id long, elapsed int, trajectory string"


def trajectory(elapsed: int, tests: int, imaging: int, urgent: bool) -> str:
    if urgent and elapsed > LIMIT_MINUTES and not imaging:
        return "worsening"
    return "stable" if tests else "unknown"


def replay(events: DataFrame) -> DataFrame:
    """REPLY of complete sessions by running windows. events: session_id, event_id, kind (start_urgent, message, test, imaging), at."""
    w = Window.partitionBy("session_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def upto(*kinds: str):
        return F.sum(F.col("kind").isin(*kinds).cast("int")).over(w)

    rows = events.withColumns({
        "elapsed": (F.count("*").over(w) * STEP_MINUTES).cast("int"), "_tests": upto("test", "imaging"), "_imaging": upto("imaging"), "_urgent": upto("start_urgent"),
    })
    worse = (F.col("_urgent") > 0) & (F.col("elapsed") > LIMIT_MINUTES) & (F.col("_imaging") == 0)
    state = F.when(worse, "worsening").when(F.col("_tests") > 0, "stable").otherwise("unknown")
    return rows.select("session_id", "event_id", "elapsed", state.alias("trajectory"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    elapsed, tests, imaging, urgent = state.get if state.exists else (0, 0, 0, False)
    rows, ended = [], False
    pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
    for event, kind in zip(pdf["event_id"], pdf["kind"], strict=True):
        elapsed += STEP_MINUTES
        tests += kind in ("test", "imaging")
        imaging += kind == "imaging"
        urgent = bool(urgent or kind == "start_urgent")
        ended = kind == "end"
        rows.append((key[0], event, elapsed, trajectory(elapsed, tests, imaging, urgent)))
    if ended:
        state.remove()
    else:
        state.update((elapsed, tests, imaging, urgent))
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in REPLY.split(", ")])


def track(stream: DataFrame) -> DataFrame:
    """REPLY of a stream of events, a row for each event; an end event clears its session's state."""
    ship(stream.sparkSession)
    return stream.groupBy("session_id").applyInPandasWithState(_advance, REPLY, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, at: str, by: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; events later than the watermark are left out. Works on streams and tables."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def final_turns(turns: DataFrame, phrases: list[str], least: int = 3, most: int = 10) -> DataFrame:
    """conv_id, final_turn, forced: the first turn from `least` on with a phrase, else the last allowed one."""
    pattern = "|".join(re.escape(p) for p in phrases)
    hit = F.min(F.when((F.col("turn") >= least) & F.col("text").rlike(pattern), F.col("turn")))
    last = F.least(F.max("turn"), F.lit(most).cast("long"))
    return turns.groupBy("conv_id").agg(hit.alias("_hit"), last.alias("_last")).select("conv_id", F.coalesce("_hit", "_last").alias("final_turn"), F.col("_hit").isNull().alias("forced"))
