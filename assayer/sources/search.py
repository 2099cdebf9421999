"""A search source for Spark: a partition for each query and year, read from pages that were saved before.

Fetching over a network is left to a subclass of Fetcher; the one here reads a folder, so everything runs offline.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Fetcher:
    """Gives the result rows of one query and year."""

    def search(self, query: str, year: int) -> Iterator[dict]:
        raise NotImplementedError


class FolderFetcher(Fetcher):
    """Rows of <folder>/<query>-<year>.jsonl; a missing file has none."""

    def __init__(self, folder: str):
        self.folder = folder

    def search(self, query: str, year: int) -> Iterator[dict]:
        name = re.sub(r"[^a-z0-9]+", "_", query.lower())
        path = os.path.join(self.folder, f"{name}-{year}.jsonl")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                yield from map(json.loads, f)


@dataclass
class QueryYear(InputPartition):
    query: str
    year: int


class SearchSource(DataSource):
    """Options: queries (separated by |), first and last year, folder."""

    @classmethod
    def name(cls) -> str:
        return "case_search"

    def schema(self) -> str:
        return "query string, year int, title string, url string, date string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries = [q for q in options.get("queries", "").split("|") if q]
        self.years = range(int(options.get("first", "2020")), int(options.get("last", "2020")) + 1)
        self.folder = options.get("folder", "")

    def partitions(self) -> list[InputPartition]:
        return [QueryYear(q, y) for q in self.queries for y in self.years]

    def read(self, partition: QueryYear):
        for row in FolderFetcher(self.folder).search(partition.query, partition.year):
            yield (partition.query, partition.year, row.get("title"), row.get("url"), row.get("date"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
