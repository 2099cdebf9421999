"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assayer.shipping import ship

__all__ = ["crc_mod", "free_name", "held", "lower_ascii", "map_lists", "read", "release", "shared_dir", "ship", "small_batches", "tokenizer_path", "written"]

#: Rows of an Arrow batch that are turned into Python values at once.
SLICE_ROWS = 500
#: Rows of an Arrow batch where stages follow each other and workers of several stages live beside the same executor.
ARROW_ROWS = 1000
#: Spark's switch by which a query's shuffle files go with its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HELD: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """A value that a Python worker keeps over its tasks: one at a time, so that asking for another drops it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release(keep: bool = False) -> None:
    """Give free memory back to the system, so that a worker that is used again does not keep what a task had at its largest.

    What the worker holds for later tasks goes as well, unless it is to be kept.
    """
    if not keep:
        _HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_lists(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterable[dict]], schema: str, holds: bool = False) -> DataFrame:
    """mapInArrow with plain lists by column in and lists or arrays by column out.

    64-bit ids beside nulls stay exact, as nothing passes through floats. What a worker holds of another operator is dropped
    unless run holds something itself.
    """
    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield {name: column.to_pylist() for name, column in zip(part.schema.names, part.columns, strict=True)}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            _HELD.clear()
        for out in run(slices(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=target)
        release(holds)

    return df.mapInArrow(over, schema)


def small_batches(spark: SparkSession) -> None:
    """Whole texts and pairs of them go to Python workers in batches of ARROW_ROWS rows at most, for this session."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets a temporary one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        known = sc._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='assayer-')}"
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. The files go when the application ends.

    What was shuffled for it goes at once: else it would lie on the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assayer-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key written as text, modulo n; null keys count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))


def free_name(df: DataFrame, base: str) -> str:
    """base, with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: from $ASSAYER_TOKENIZERS if set, else from the installed package of vocabularies."""
    if root := os.environ.get("ASSAYER_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)
