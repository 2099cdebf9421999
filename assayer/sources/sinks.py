"""Writers. Each writes a folder of files, never through the driver; snapshots are new folders, inputs are not changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_csv(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def as_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def export(runs: DataFrame, criteria: DataFrame, path: str, parquet: bool = True) -> None:
    """Runs and criteria as CSV and, if wanted, Parquet; computed once."""
    runs, criteria = runs.persist(), criteria.persist()
    try:
        for name, df in (("runs", runs), ("criteria", criteria)):
            as_csv(df, f"{path}/csv/{name}")
            if parquet:
                as_parquet(df, f"{path}/parquet/{name}")
    finally:
        runs.unpersist()
        criteria.unpersist()


def cost_summary(df: DataFrame, path: str, kind: str, lists: Sequence[str] = ("unmatched_procedures",)) -> None:
    """csv (lists joined by |), json or parquet; another kind raises."""
    if kind == "csv":
        joined = {c: F.concat_ws("|", c) for c in lists if c in df.columns}
        df.withColumns(joined).write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def requests(df: DataFrame, path: str, key: str, prompt: str, model: str) -> DataFrame:
    """Request lines as JSON and the mapping from custom_id to key, which is returned and written beside them."""
    made = df.withColumn("custom_id", F.concat(F.lit("req-"), F.lower(F.hex(F.xxhash64(key)))))
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))).alias("messages"))
    made.select("custom_id", F.lit("POST").alias("method"), body.alias("body")).write.mode("overwrite").json(f"{path}/requests")
    mapping = made.select("custom_id", key)
    mapping.write.mode("overwrite").json(f"{path}/mapping")
    return mapping


def quarantined(df: DataFrame, reason: str, path: str) -> None:
    """Kept and quarantined rows in two folders."""
    df.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(f"{path}/kept")
    df.where(F.col(reason).isNotNull()).write.mode("overwrite").parquet(f"{path}/quarantined")


def with_evaluation(logs: DataFrame, results: DataFrame, key: str, field: str) -> DataFrame:
    """A new snapshot of logs with one more evaluation; logs without a result keep what they had."""
    joined = logs.join(results.withColumnRenamed(field, "_new"), key, "left")
    old = F.col(field) if field in logs.columns else F.lit(None).cast(dict(results.dtypes)[field])
    return joined.withColumn(field, F.coalesce("_new", old)).drop("_new")


def fresh(cache: DataFrame, days: int = 30) -> DataFrame:
    """Cached responses that are not too old."""
    return cache.where(F.col("fetched_at") > F.current_timestamp() - F.make_interval(days=F.lit(days)))


def markdown(df: DataFrame, digits: int = 2) -> str:
    """A small aggregated frame as a table."""
    rows = df.collect()

    def text(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows])
