"""Work on keys whose rows have an order, where one key may hold any share of all rows.

Rows are dealt in ranges of key and order, so that a large key lies over many tasks and a task holds whole keys but for its
first and last one. What must be told of a key in order, such as a SHA-256, is then put together from few and larger chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import free_name, map_lists

#: Bytes of a chunk, beyond which it is given out.
CHUNK_BYTES = 1 << 16


def in_ranges(df: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """df in ranges of keys (nulls first), sorted within each, with the number of the range; equal rows may lie in several ranges."""
    spread = free_name(df, "spread")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(n, *keys, spread)
    return dealt.sortWithinPartitions(*keys).drop(spread).withColumn(part, F.spark_partition_id())


def chunked(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, at, chunk: the decimal values of each key (long), ascending and comma-joined, in chunks whose order is at."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, held, size, made = None, [], 0, 0

        def given(out: dict) -> None:
            nonlocal made
            for name, x in (("key", now), ("at", (part << 32) + made), ("chunk", b",".join(held))):
                out[name].append(x)
            made += 1

        for rows in batches:
            out: dict = {"key": [], "at": [], "chunk": []}
            for k, v, part in zip(rows["key"], rows["value"], rows["part"], strict=True):
                if held and (k != now or size > CHUNK_BYTES):
                    given(out)
                    held, size = [], 0
                now = k
                held.append(b"%d" % v)
                size += len(held[-1]) + 1
            yield out
        if held:
            out = {"key": [], "at": [], "chunk": []}
            given(out)
            yield out

    rows = in_ranges(df.select(F.col(key).alias("key"), F.col(value).alias("value")), ["key", "value"])
    return map_lists(rows, run, "key long, at long, chunk binary")


def chained_sha256(chunks: DataFrame, separator: bytes) -> DataFrame:
    """key, sha256: of each key's chunks (key long, at, chunk) in the order of at, joined by separator; empty chunks are left out.

    A hash is a chain: a key's chunks pass one task, in order, but one at a time and never as a whole.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now, chain, begun = None, None, False
        for rows in batches:
            out: dict = {"key": [], "sha256": []}
            for k, chunk in zip(rows["key"], rows["chunk"], strict=True):
                if chain is None or k != now:
                    if chain is not None:
                        out["key"].append(now)
                        out["sha256"].append(chain.hexdigest())
                    now, chain, begun = k, hashlib.sha256(), False
                if chunk:
                    chain.update(separator + chunk if begun else chunk)
                    begun = True
            yield out
        if chain is not None:
            yield {"key": [now], "sha256": [chain.hexdigest()]}

    rows = chunks.select("key", "at", "chunk").repartition("key").sortWithinPartitions("key", "at")
    return map_lists(rows.select("key", "chunk"), run, "key long, sha256 string")
