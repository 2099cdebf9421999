"""Runs and their criteria as two tables laid out for their join: both bucketed and sorted by run, so that it needs no shuffle.

In place of secondary indexes the columns that are looked up have Parquet Bloom filters, by which row groups are skipped.
A run's criteria lie in one bucket, as its row does; a bucket is written as one sorted file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators.frontier import first_of, ranked

#: The exported columns of a run, in their order, and their types. Scores of judges and primary scores stay out.
RUN_COLUMNS = (
    "run_id string, case_id string, jurisdiction string, specialty string, malpractice_type string, liability_code int, "
    "llm_name string, score_0_2 int, risk_flag int, defendant_action string, expected_action string, missing_criteria_count int, "
    "met_criteria_count int, reasoning_quality_score double, started_at string, ended_at string, feedback string, "
    "recommendation_length int, questions_asked int, score_valid int, deferral_reason string, flesch_kincaid_grade double, "
    "smog_index double, transformer_readability_score double, transformer_model_name string, lexical_overlap_adjacent double, "
    "lexical_overlap_global double, pronoun_density double, semantic_coherence_local double, semantic_coherence_global double"
)
CRITERION_COLUMNS = "id long, run_id string, criterion string, met int, reason string"
#: Truths that are stored as 1, or as 0 where they are false or null.
FLAGS = ("risk_flag", "score_valid", "met")
#: Columns that runs are looked up by.
LOOKED_UP = ("case_id", "llm_name", "jurisdiction", "malpractice_type", "liability_code", "specialty")


@dataclass(frozen=True)
class Tables:
    """Names of the two tables, and their folders' parent."""

    runs: str
    criteria: str
    path: str


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl, in their order and types; those that it lacks are null, others go."""
    out = []
    for f in StructType.fromDDL(ddl).fields:
        col = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append((F.when(F.coalesce(col.cast("boolean"), F.lit(False)), 1).otherwise(0) if f.name in FLAGS else col.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def _store(df: DataFrame, name: str, path: str, buckets: int, looked_up: tuple[str, ...] = ()) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    out = df.repartition(buckets, "run_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "run_id").sortBy("run_id").option("path", path)
    if looked_up:
        out = out.option("parquet.bloom.filter.adaptive.enabled", "true")  # sized by the values of a file, not the largest size for each
    for c in looked_up:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.saveAsTable(name)


def export_tables(runs: DataFrame, criteria: DataFrame | None, path: str, prefix: str, buckets: int = 32) -> Tables:
    """Replace the tables <prefix>_runs and <prefix>_criteria under path.

    A run_id that occurs twice raises ValueError, before the criteria are written (null ids may repeat, and join nothing).
    Criteria are numbered from 1 by run, criterion and reason. Without criteria their table is empty.
    """
    spark = runs.sparkSession
    made = Tables(f"{prefix}_runs", f"{prefix}_criteria", path)
    _store(shaped(runs, RUN_COLUMNS), made.runs, f"{path}/runs", buckets, LOOKED_UP)
    twice = spark.table(made.runs).where("run_id IS NOT NULL").groupBy("run_id").count().where("count > 1").limit(1).collect()
    if twice:
        spark.sql(f"DROP TABLE {made.runs}")
        raise ValueError(f"run_id {twice[0]['run_id']} occurs {twice[0]['count']} times")
    rows = shaped(spark.createDataFrame([], CRITERION_COLUMNS) if criteria is None else criteria, CRITERION_COLUMNS).drop("id")
    numbered, _ = first_of(ranked(rows, "run_id", "criterion", "reason", "met"), 1 << 62)
    _store(shaped(numbered.withColumn("id", F.col("found_as") + 1), CRITERION_COLUMNS), made.criteria, f"{path}/criteria", buckets)
    return made


def opened(spark: SparkSession, path: str, prefix: str, buckets: int = 32) -> Tables:
    """Tables that were exported to path, made known to a session whose catalog has forgotten them."""
    made = Tables(f"{prefix}_runs", f"{prefix}_criteria", path)
    for name, ddl, folder in ((made.runs, RUN_COLUMNS, "runs"), (made.criteria, CRITERION_COLUMNS, "criteria")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (run_id) SORTED BY (run_id) INTO {buckets} BUCKETS LOCATION '{path}/{folder}'")
    return made


def joined(spark: SparkSession, tables: Tables) -> DataFrame:
    """A row for each criterion with its run's columns; criteria of unknown runs are left out."""
    return spark.table(tables.criteria).hint("merge").join(spark.table(tables.runs), "run_id")
