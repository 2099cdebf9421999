"""Readers with explicit schemas and error side-outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import schemas
from assayer.functions import ladders
from assayer.functions.text import iso_time
from assayer.operators import votes

CORRUPT = "_corrupt"


def json_files(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One row per file, or per line; what does not parse stays, with its text in _corrupt and its file in _file."""
    reader = spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("multiLine", not lines).option("pathGlobFilter", "*.jsonl" if lines else "*.json").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Session logs, and the files that are rejected with the reason: unreadable, ids missing, or a score out of 0..2."""
    rows = json_files(spark, path, schemas.LOG)
    scores = F.array(*[F.col(f"{e}.score") for e in ("evaluation", "evaluation_claude", "evaluation_grok", "evaluation_gpt5")])
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "unreadable")
        .when(F.col("session_id").isNull() | F.col("case_id").isNull(), "missing_id")
        .when(F.exists(scores, lambda s: ~s.between(0, 2)), "score_out_of_range")
    )
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason", CORRUPT), marked.where("reason IS NOT NULL").select("_file", "reason")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Case documents of either top-level shape; a missing id is the file's name. Lists that some files hold as texts are read as text."""
    rows = json_files(spark, path, schemas.CASE).where(F.col(CORRUPT).isNull())
    return rows.withColumns({"case_id": F.coalesce("case_id", stem(F.col("_file"))), "url": F.coalesce("url", "source_url")}).drop(CORRUPT)


def untestable_ids(case_rows: DataFrame) -> DataFrame:
    return case_rows.where(F.col("simulation.testable") == F.lit(False)).select("case_id")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV; empty fields are null, and so is what does not parse."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "").csv(path)


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Prices with codes as text and the load order by file and position; rows without a code drop."""
    rows = csv(spark, path, schemas.PRICES).where("primary_code IS NOT NULL AND primary_code != ''")
    return rows.withColumn("load_ordinal", F.monotonically_increasing_id())


def optional(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A source that may be missing: then an empty frame of the same schema."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not there:
        return spark.createDataFrame([], schema)
    return csv(spark, path, schema) if kind == "csv" else spark.read.schema(schema).format(kind).load(path)


def completed(log_rows: DataFrame, model: str) -> DataFrame:
    return log_rows.where(F.col("llm_name") == model).select("case_id").distinct()


def run_records(log_rows: DataFrame, untestable: DataFrame, marker: str = "[FINAL RECOMMENDATION]") -> tuple[DataFrame, DataFrame]:
    """The flat run table and the skipped runs of untestable cases. Without an evaluation the score is 1, flagged eval_missing."""
    e = F.col("evaluation")
    score = F.coalesce(e["score"], F.lit(1))
    turns = F.coalesce("conversation", F.array().cast("array<struct<role:string,content:string,timestamp:string>>"))
    marked = F.transform(turns, lambda t: F.coalesce(F.contains(t["content"], F.lit(marker)), F.lit(False)))
    end = F.array_position(marked, F.lit(True))
    asked = F.filter(turns, lambda t, k: (t["role"] == "user") & ((end == 0) | (k + 1 < end)))
    checked = F.coalesce(e["checklist"], F.array().cast("array<struct<criterion:string,met:boolean,reason:string>>"))
    flat = log_rows.select(
        F.col("session_id").alias("run_id"), "case_id", "llm_name",
        ladders.jurisdiction(F.col("case_id")).alias("jurisdiction"),
        score.alias("score_0_2"), e.isNull().alias("eval_missing"), F.coalesce(e["risk_flag"], F.lit(False)).alias("risk_flag"),
        ladders.liability_code(score, e["risk_flag"]).alias("liability_code"),
        F.size(F.filter(checked, lambda c: c["met"])).alias("met_criteria_count"),
        F.size(F.filter(checked, lambda c: ~F.coalesce(c["met"], F.lit(False)))).alias("missing_criteria_count"),
        iso_time(F.col("started_at")).alias("started_at"), iso_time(F.col("ended_at")).alias("ended_at"),
        F.length("final_recommendation").alias("recommendation_length"),
        F.nullif(F.size(asked), F.lit(0)).alias("questions_asked"),
        F.coalesce(e["score_valid"], F.lit(True)).alias("score_valid"),
        F.col("evaluation_claude.score").alias("claude"), F.col("evaluation_grok.score").alias("grok"), F.col("evaluation_gpt5.score").alias("gpt5"),
        checked.alias("checklist"),
    )
    voted = votes.with_votes(flat, ("claude", "grok", "gpt5"))
    return voted.join(untestable, "case_id", "left_anti"), voted.join(untestable, "case_id", "left_semi")


def criteria(runs: DataFrame) -> DataFrame:
    """run_id, criterion, met, reason: a row for each checklist item."""
    return runs.select("run_id", F.explode("checklist").alias("c")).select("run_id", "c.criterion", F.coalesce("c.met", F.lit(False)).alias("met"), "c.reason")
