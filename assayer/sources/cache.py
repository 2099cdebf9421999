"""A cache of fetched rows that expire, in Parquet by day of fetch.

An upsert rewrites the days that it touches: those of the new rows and those in which older rows with the same keys lie. The
later fetch wins, wherever it comes from. Days that are left without a row go, and so do days that have expired as a whole. A
reader resolves keys by their latest fetch as well, so a put that broke off between writing and removing leaves nothing wrong.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.sources.stored import written

#: Fixed value: days that a fetched row is good for.
LIFETIME_DAYS = 30


@dataclass
class ExpiringCache:
    """schema: DDL of the rows, with the key's column and fetched_at (a timestamp). Rows without a key or a time are left out."""

    spark: SparkSession
    folder: str
    schema: str
    key: str
    days: int = LIFETIME_DAYS

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the latest fetch; of equal ones the greatest values."""
        names = [c for c in StructType.fromDDL(self.schema).names if c not in (self.key, "fetched_at")]
        best = rows.groupBy(self.key).agg(F.max(F.struct("fetched_at", *names)).alias("_x"))
        return best.select(self.key, *[F.col(f"_x.{c}").alias(c) for c in ("fetched_at", *names)]).select(*StructType.fromDDL(self.schema).names)

    def _fresh(self, now: datetime.datetime) -> Column:
        return F.col("fetched_at") > F.lit(now - datetime.timedelta(days=self.days))

    def _partitions(self) -> dict[str, object]:
        """Path by day: as many as days that are kept."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = self._fs.listStatus(root) if self._fs.exists(root) else []
        return {s.getPath().getName().split("=")[1]: s.getPath() for s in found if s.getPath().getName().startswith("day=")}

    def _stored(self) -> DataFrame:
        kept = f"{self.schema}, day date"
        return self.spark.read.schema(kept).parquet(self.folder) if self._partitions() else self.spark.createDataFrame([], kept)

    def get(self, now: datetime.datetime) -> DataFrame:
        """The rows that have not expired, one for each key."""
        earliest = (now - datetime.timedelta(days=self.days + 1)).date()
        return self._latest(self._stored().where(F.col("day") >= F.lit(earliest))).where(self._fresh(now))

    def put(self, rows: DataFrame, now: datetime.datetime) -> None:
        names = StructType.fromDDL(self.schema).names
        new = written(self._latest(rows.select(*names).where(F.col(self.key).isNotNull() & F.col("fetched_at").isNotNull())).withColumn("day", F.to_date("fetched_at")))
        stored = self._stored()
        again = stored.join(new.select(self.key), self.key, "left_semi").select("day")
        touched = {str(r["day"]) for r in new.select("day").union(again).distinct().collect()}  # days that are kept, and those of the new rows
        both = stored.where(F.col("day").isin([datetime.date.fromisoformat(d) for d in touched])).unionByName(new)
        kept = written(self._latest(both).where(self._fresh(now)).withColumn("day", F.to_date("fetched_at")))
        kept.repartition("day", F.pmod(F.xxhash64(self.key), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.folder)
        filled = {str(r["day"]) for r in kept.select("day").distinct().collect()}
        last = (now - datetime.timedelta(days=self.days)).date().isoformat()
        for day, path in self._partitions().items():
            if day in touched - filled or day < last:
                self._fs.delete(path, True)
