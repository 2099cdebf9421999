"""Folds over the ordered rows of each key, many keys to a task and no key held as a whole.

Rows are dealt by key, sorted within each task, and pass a state that is made anew for each key: memory is what the state holds,
whatever a key's number of rows. Only the columns that the fold reads are sent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from assayer.shipping import ship

#: Rows of output that are given out at once.
GIVEN = 5000


class Fold(Protocol):
    """A state for one key."""

    def add(self, *row: Any) -> Iterator[tuple]:
        """Takes the next row's columns and yields what is settled by now."""

    def end(self) -> Iterator[tuple]:
        """Yields the rest."""


def folded(df: DataFrame, key: str, order: list[Column], columns: dict[str, Column], make: Callable[[], Fold], schema: str) -> DataFrame:
    """key and schema: what a fold made by make yields over the columns of each key's rows, in order. Null keys are one key."""
    kind, names = dict(df.dtypes)[key], [*columns]
    target = to_arrow_schema(StructType.fromDDL(f"key {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now, out = None, None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *names)), strict=True):
                if fold is None or k != now:
                    if fold is not None:
                        out += [(now, *r) for r in fold.end()]
                    fold, now = make(), k
                out += [(now, *r) for r in fold.add(*row)]
                if len(out) >= GIVEN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target)], schema=target)
                    out = []
        if fold is not None:
            out += [(now, *r) for r in fold.end()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target)], schema=target)

    ship(df.sparkSession)
    placed = [f"_o{k}" for k in range(len(order))]
    rows = df.select(F.col(key).alias("key"), *[c.alias(n) for n, c in columns.items()], *[c.alias(n) for c, n in zip(order, placed, strict=True)])
    dealt = rows.repartition("key").sortWithinPartitions("key", *placed, *names).select("key", *names)
    return dealt.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


class Packing:
    """Segments under a budget of tokens; each starts with the last items of the one before that fit the overlap together.

    Kept are the segment's sums and those items at its end that may still be carried over: items without tokens stand with the
    item after them, so there are as many as the overlap has tokens at most, and one.
    """

    def __init__(self, budget: int, overlap: int):
        self.budget, self.overlap = budget, overlap
        self.number, self.group = 0, None
        self._clear()

    def _clear(self) -> None:
        self.first = self.last = None
        self.total, self.carried = 0, False
        self.tail: deque[tuple[int, int]] = deque()  # first position and tokens
        self.kept = 0

    def add(self, group: Any, pos: int, tokens: int | None) -> Iterator[tuple]:
        tokens = tokens or 0
        if group != self.group:
            yield from self.end()
            self.group = group
        elif self.first is not None and self.total + tokens > self.budget:
            yield self._told()
            tail, kept = self.tail, self.kept
            if kept + tokens > self.budget:
                tail, kept = deque(), 0
            self._clear()
            self.tail, self.kept, self.total, self.carried = tail, kept, kept, bool(tail)
            self.first = tail[0][0] if tail else None
        self.first = pos if self.first is None else self.first
        self.last = pos
        self.total += tokens
        start = self.tail.pop()[0] if self.tail and not self.tail[-1][1] else pos
        self.tail.append((start, tokens))
        self.kept += tokens
        while self.kept > self.overlap:
            self.kept -= self.tail.popleft()[1]

    def _told(self) -> tuple:
        self.number += 1
        return (self.number - 1, self.first, self.last, self.total, self.carried)

    def end(self) -> Iterator[tuple]:
        if self.first is not None:
            yield self._told()
        self._clear()


class Selection:
    """Which paragraphs fit their share of a budget: the last ones from the end, those with terms, the first ones, then the others.

    The last ones are known only at the end, so that many rows are held back; a row that leaves them is settled at once.
    """

    def __init__(self, rooms: tuple[int, int, int, int], last: int, first: int):
        self.at_end, self.room = rooms[0], dict(zip(("term", "first", "middle"), rooms[1:], strict=True))
        self.most_last, self.most_first = last, first
        self.held: deque[tuple] = deque()
        self.seen = 0

    def add(self, pos: int, tokens: int | None, hit: bool | None) -> Iterator[tuple]:
        self.held.append((self.seen, pos, tokens or 0, bool(hit)))
        self.seen += 1
        if len(self.held) > self.most_last:
            yield from self._settled(self.held.popleft())

    def _settled(self, row: tuple) -> Iterator[tuple]:
        place, pos, tokens, hit = row
        for reason, open_to in (("term", hit), ("first", place < self.most_first), ("middle", True)):
            if open_to and tokens <= self.room[reason]:
                self.room[reason] -= tokens
                yield pos, reason
                return

    def end(self) -> Iterator[tuple]:
        taken = set()
        for place, pos, tokens, _ in reversed(self.held):
            if tokens <= self.at_end:
                self.at_end -= tokens
                taken.add(place)
                yield pos, "last"
        for row in self.held:
            if row[0] not in taken:
                yield from self._settled(row)
