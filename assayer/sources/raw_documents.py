"""Raw documents as files of their own: the `raw_documents` sink writes each row's bytes under <path>/<source>/<id><ending>.

A task writes its files beside the targets, under a name of the write and of the attempt; the commit on the driver moves what the
successful tasks wrote into place, file by file, and removes the rest. An aborted write, a failed task or one that ran twice thus
leaves no document. Documents that were there before are replaced; mode overwrite removes all sources' folders first. The folder is one that driver and executors share.

Rows: id string, source string, url string, content binary. The ending is .pdf if the address has "pdf" in it, and .html
else; null content is an empty file. A null id, or one with characters that a file name cannot have, raises ValueError, and so
do two rows for one file: nothing is renamed in silence.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SAFE = re.compile(r"[\w.=+@-]+")


def ending(url: str | None) -> str:
    return ".pdf" if url and "pdf" in url.lower() else ".html"


def relative_path(row: Row) -> str:
    for part in (row["id"], row["source"]):
        if part is None or not SAFE.fullmatch(part) or part in (".", ".."):
            raise ValueError(f"not a file name: {part!r}")
    return os.path.join(row["source"].lower(), row["id"] + ending(row["url"]))


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, beside a file with their targets, which the driver reads line by line."""

    staged: str
    number: int


class RawWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staging = os.path.join(self.path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        mine = os.path.join(self.staging, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(mine, exist_ok=True)
        number = 0
        with open(os.path.join(mine, "targets"), "w", encoding="utf-8") as targets:
            for row in iterator:
                targets.write(relative_path(row) + "\n")
                with open(os.path.join(mine, str(number)), "wb") as f:
                    f.write(row["content"] or b"")
                number += 1
        return Written(mine, number)

    def commit(self, messages: list[Written | None]) -> None:
        try:
            self._check_targets(messages)
            os.makedirs(self.path, exist_ok=True)
            old = [e.path for e in os.scandir(self.path) if e.is_dir() and not e.name.startswith("_writing-")] if self.overwrite else []
            for folder in old:
                shutil.rmtree(folder)
            for where, number, target in self._targets(messages):
                to = os.path.join(self.path, target)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                os.replace(os.path.join(where, str(number)), to)
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def _targets(self, messages: list[Written | None]) -> Iterator[tuple[str, int, str]]:
        for m in messages:
            if m is not None:
                with open(os.path.join(m.staged, "targets"), encoding="utf-8") as f:
                    yield from ((m.staged, k, line.rstrip("\n")) for k, line in enumerate(f))

    def _check_targets(self, messages: list[Written | None]) -> None:
        """Claims each target by a file of its name; the second claim fails."""
        for _, _, target in self._targets(messages):
            claim = os.path.join(self.staging, "claims", target)
            os.makedirs(os.path.dirname(claim), exist_ok=True)
            try:
                open(claim, "x").close()
            except FileExistsError:
                raise ValueError(f"two rows for {target}") from None

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class RawDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_documents"

    def schema(self) -> str:
        return "id string, source string, url string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RawWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawDocuments)
