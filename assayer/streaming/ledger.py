"""Sinks of a stream whose effect is exact although batches may come again.

A batch writes under its own number, which overwrites whatever an earlier attempt left there, and is entered in a ledger as the
last thing. A number that the ledger has is left alone. What is read is what the latest entry names, so a batch counts whole or
not at all. Tables are kept in a fixed number of buckets by a hash of the key: a batch rewrites the buckets that it touches, and
the entry says for every bucket which batch wrote it last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.folds import folded

#: Buckets of a table; an entry of the ledger has a row for each.
BUCKETS = 64

# The statuses of a case in the queue.
STATUSES = ("queued", "fetching", "fetched", "parsing", "parsed", "extracting", "extracted", "validated", "rejected", "error")
#: Which status may follow which; "" stands for a case that is not there yet. Work goes on step by step, may be rejected or fail at
#: any step, and what failed is queued again.
LEGAL = frozenset(
    {("", "queued"), ("error", "queued")}
    | set(zip(STATUSES[:7], STATUSES[1:8]))
    | {(s, end) for s in STATUSES[:8] for end in ("rejected", "error") if (s, end) != ("validated", "error")}
)


@dataclass
class Ledger:
    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, batch: int) -> str:
        return f"{self.folder}/ledger/batch={batch}"

    def has(self, batch: int) -> bool:
        target, fs = self._fs(f"{self._path(batch)}/_SUCCESS")
        return fs.exists(target)

    def latest(self) -> int | None:
        target, fs = self._fs(f"{self.folder}/ledger")
        names = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(target)] if fs.exists(target) else []
        return max((b for b in names if self.has(b)), default=None)

    def versions(self) -> dict[int, int]:
        """By bucket, the batch that wrote it last."""
        batch = self.latest()
        return {} if batch is None else {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(self._path(batch)).collect()}

    def enter(self, batch: int, versions: dict[int, int]) -> None:
        rows = self.spark.createDataFrame([*versions.items()], "bucket int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(self._path(batch))


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Status:
    """A case's status as its events pass; the stored status, if any, comes first."""

    def __init__(self):
        self.status, self.at, self.event, self.changes = "", None, None, 0

    def add(self, stored, event, status, at, changes):
        if stored:  # at most one, and before all events
            self.status, self.at, self.event, self.changes = status, at, event, changes
            return
        late = self.event is not None and (at, event) <= (self.at, self.event)
        if late or (self.status, status) not in LEGAL:
            yield "illegal", self.status, status, event, at, self.changes, "late" if late else "unknown" if status not in STATUSES else "transition"
            return
        self.status, self.at, self.event, self.changes = status, at, event, self.changes + 1

    def end(self):
        if self.event is not None:
            yield "state", None, self.status, self.event, self.at, self.changes, None


FOLDED = "kind string, was string, status string, event_id long, at timestamp, changes long, reason string"
STATE = "case_id string, status string, event_id long, at timestamp, changes long"


def advanced(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """case_id and FOLDED: the status of each case of events (case_id, event_id, status, at), and the events that were not legal.

    Events go by at and event_id. One that is not after the last that counted is late: an event that comes twice changes nothing.
    Events without an id or a time are left out; a null status is unknown.
    """
    rows = events.where("event_id IS NOT NULL AND at IS NOT NULL").select(F.col("case_id").cast("string"), F.lit(False).alias("stored"), "event_id", "status", "at", F.lit(0).cast("long").alias("changes"))
    if stored is not None:
        rows = rows.unionByName(stored.select("case_id", F.lit(True).alias("stored"), "event_id", "status", "at", "changes"))
    return folded(rows, "case_id", [~F.col("stored"), F.col("at"), F.col("event_id")], {c: F.col(c) for c in ("stored", "event_id", "status", "at", "changes")}, Status, FOLDED)


@dataclass
class StatusTable:
    """The status of every case, merged from batches; given to foreachBatch as it is."""

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self.ledger = Ledger(self.spark, self.folder)

    def _parts(self, kind: str, versions: dict[int, int]) -> list[str]:
        paths = [f"{self.folder}/changes/batch={v}/kind={kind}/bucket={b}" for b, v in sorted(versions.items())]
        return [p for p in paths if self.ledger._fs(p)[1].exists(self.ledger._fs(p)[0])]

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        versions = {b: v for b, v in self.ledger.versions().items() if buckets is None or b in buckets}
        paths = self._parts("state", versions)
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def illegal(self) -> DataFrame:
        """What the batches of the ledger turned away: case_id, was, status, event_id, at, reason, batch."""
        schema = "case_id string, was string, status string, event_id long, at timestamp, reason string, batch long"
        target, fs = self.ledger._fs(f"{self.folder}/changes")
        found = [s.getPath().toString() for s in fs.listStatus(target)] if fs.exists(target) else []
        paths = [f"{p}/kind=illegal" for p in found if self.ledger.has(int(p.rsplit("=", 1)[1])) and fs.exists(self.ledger._fs(f"{p}/kind=illegal")[0])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.folder}/changes").schema(f"{schema}, kind string, bucket int").parquet(*paths).drop("kind", "bucket")

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.ledger.has(number):
            return
        events = batch.select("case_id", "event_id", "status", "at").withColumn("case_id", F.col("case_id").cast("string"))
        touched = sorted(r["bucket"] for r in events.select(bucket("case_id").alias("bucket")).distinct().collect())  # BUCKETS at most
        versions = self.ledger.versions()
        merged = advanced(events, self.state(touched)).withColumn("bucket", bucket("case_id"))
        merged.repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.folder}/changes/batch={number}")
        self.ledger.enter(number, versions | {b: number for b in touched})


LINE = "session_id string, case_id string, jurisdiction string, llm_name string, seq long, role string, content string, timestamp string, kind string"
SESSION = ("session_id", "case_id", "jurisdiction", "llm_name")


@dataclass
class SessionLog:
    """The lines of sessions, taken up batch by batch; given to foreachBatch as it is."""

    spark: SparkSession
    folder: str

    def __post_init__(self):
        self.ledger = Ledger(self.spark, self.folder)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.ledger.has(number):
            return
        batch.select(*[f.split()[0] for f in LINE.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/lines/batch={number}")
        self.ledger.enter(number, {0: number})

    def lines(self) -> DataFrame:
        """The lines of entered batches; of lines with the same session and seq that of the latest batch."""
        target, fs = self.ledger._fs(f"{self.folder}/lines")
        found = [s.getPath().toString() for s in fs.listStatus(target)] if fs.exists(target) else []
        paths = [p for p in found if self.ledger.has(int(p.rsplit("=", 1)[1]))]
        if not paths:
            return self.spark.createDataFrame([], f"{LINE}, batch long")
        rows = self.spark.read.option("basePath", f"{self.folder}/lines").schema(f"{LINE}, batch long").parquet(*paths)
        others = [c for c in rows.columns if c not in ("session_id", "seq")]
        last = rows.groupBy("session_id", "seq").agg(F.max(F.struct("batch", *[c for c in others if c != "batch"])).alias("x"))
        return last.select("session_id", "seq", *[F.col(f"x.{c}").alias(c) for c in others]).select(*rows.columns)

    def documents(self) -> DataFrame:
        """session_id, document: each session as one JSON document with its lines in order, its first and last time and its recommendation."""
        rows = self.lines()
        said = F.struct("seq", F.struct("role", "content", "timestamp").alias("line"))
        talk = rows.groupBy("session_id").agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SESSION[1:]],
            F.min("timestamp").alias("started_at"), F.max(F.when(F.col("kind") == "end", F.col("timestamp"))).alias("ended_at"),
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "said", said))), lambda x: x["line"]).alias("conversation"),
            F.max_by("content", F.when(F.col("kind") == "recommendation", F.col("seq"))).alias("final_recommendation"),
        )
        return talk.select("session_id", F.to_json(F.struct(*talk.columns)).alias("document"))
