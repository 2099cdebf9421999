"""Saved court index pages as a source: `case_index` reads <folder>/<court>/<year>/<page>.html, a partition for each page.

The listing is the plan: filters on court, year and date that Spark pushes down leave out folders before they are listed, and
pages that are left out are never opened. What a filter says of single entries is applied where a page is read. Spark pushes
filters to Python sources only with spark.sql.python.filterPushdown.enabled.

An entry is a link to a case with a title of at least 5 characters. Its date is the one in its title, if that lies in the
index's year, and else the year's first day, so that a year's folder bounds the dates of its entries.

As a stream, the source gives the entries of pages as they are saved: an offset is the time and path of the last page, and pages
younger than `settle` seconds wait, so that none with an earlier time comes after it. A page that is saved again is read again.
The folder is one that driver and executors share.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

#: Parts of addresses that are not cases, and of those that are.
NOT_CASES = ("index.htm", "search", "find_by", "databases", "about")
CASES = "/cases/"
LEAST_TITLE = 5
TITLE_DATE = re.compile(r"\((\d{1,2} [A-Z][a-z]+ \d{4})\)")
COMPARES = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.In: "in", ds.StringContains: "has"}


@dataclass(frozen=True)
class Test:
    """One pushed comparison of a column."""

    column: str
    op: str
    value: object

    def within(self, least, most) -> bool:
        """Whether a value from least to most may pass."""
        if self.op == "in":
            return any(least <= v <= most for v in self.value)
        return {"=": lambda v: least <= v <= most, ">": lambda v: most > v, ">=": lambda v: most >= v, "<": lambda v: least < v, "<=": lambda v: least <= v}[self.op](self.value)

    def passes(self, value) -> bool:
        return self.value in value if self.op == "has" else self.within(value, value)


def as_test(f: ds.Filter) -> Test | None:
    """The comparison that a filter makes of a column of the source; null for filters that Spark has to apply."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    op = COMPARES.get(type(f))
    if op is None or name not in {"court", "year", "date", "title"} or (op == "has") != (name == "title"):
        return None
    return Test(name, op, tuple(f.value) if op == "in" else f.value)


@dataclass
class Page(ds.InputPartition):
    court: str
    year: int
    path: str


def listed(folder: str, tests: Iterable[Test] = ()) -> Iterator[Page]:
    """The pages that may hold an entry which passes all tests, in order of their paths. Folders of other names are no index."""

    def may(column: str, least, most) -> bool:
        return all(t.within(least, most) for t in tests if t.column == column)

    for court in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if not may("court", court, court) or not os.path.isdir(os.path.join(folder, court)):
            continue
        for name in sorted(os.listdir(os.path.join(folder, court))):
            if not re.fullmatch(r"\d{4}", name) or int(name) == 0:
                continue
            year, where = int(name), os.path.join(folder, court, name)
            if may("year", year, year) and may("date", dt.date(year, 1, 1), dt.date(year, 12, 31)):
                yield from (Page(court, year, os.path.join(where, p)) for p in sorted(os.listdir(where)) if p.endswith(".html"))


class Links(HTMLParser):
    """(href, text) of a page's links in their order."""

    def __init__(self):
        super().__init__()
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = (dict(attrs).get("href") or "", [])

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], re.sub(r"\s+", " ", "".join(self.open[1])).strip()))
            self.open = None


def entry_date(title: str, year: int) -> dt.date:
    found = TITLE_DATE.search(title)
    for form in ("%d %B %Y", "%d %b %Y") if found else ():
        try:
            day = dt.datetime.strptime(found.group(1), form).date()
        except ValueError:
            continue
        if day.year == year:
            return day
    return dt.date(year, 1, 1)


class IndexPages:
    """What the reader and the stream share. A subclass may open pages elsewhere."""

    def __init__(self, options):
        self.folder, self.base = options.get("folder", ""), options.get("base", "https://example.invalid/")
        self.settle = float(options.get("settle", "1"))
        self.tests: list[Test] = []

    def open(self, page: Page) -> str:
        with open(page.path, encoding="utf-8", errors="replace") as f:
            return f.read()

    def entries(self, page: Page | None) -> Iterator[tuple]:
        """The page's entries that pass; none without a page, as Spark asks for when the listing is empty."""
        if page is None:
            return
        parser = Links()
        parser.feed(self.open(page))
        for href, title in parser.found:
            if CASES not in href or any(x in href.lower() for x in NOT_CASES) or len(title) < LEAST_TITLE:
                continue
            row = {"court": page.court, "year": page.year, "date": entry_date(title, page.year), "title": title}
            if all(t.passes(row[t.column]) for t in self.tests):
                yield page.court, page.year, os.path.basename(page.path), title, urljoin(self.base, href), row["date"]


class IndexReader(IndexPages, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            test = as_test(f)
            if test:
                self.tests.append(test)
            elif not isinstance(f, ds.IsNotNull):  # no column of an entry is null
                yield f

    def partitions(self) -> list[Page]:
        return list(listed(self.folder, self.tests))

    def read(self, partition: Page | None) -> Iterator[tuple]:
        yield from self.entries(partition)


class IndexStream(IndexPages, ds.DataSourceStreamReader):
    last = (0, "")

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def saved(self) -> list[tuple[tuple[int, str], Page]]:
        until = time.time_ns() - int(self.settle * 1e9)
        found = (((os.stat(p.path).st_mtime_ns, p.path), p) for p in listed(self.folder))
        return sorted((f for f in found if f[0][0] <= until), key=lambda f: f[0])

    def latestOffset(self) -> dict:
        self.last = max([self.last, *(at for at, _ in self.saved()[-1:])])
        return {"time": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        after, until = (start["time"], start["path"]), (end["time"], end["path"])
        return [p for at, p in self.saved() if after < at <= until]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        yield from self.entries(partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class IndexSource(ds.DataSource):
    """Options: folder, base (what links are relative to), settle (seconds; streams)."""

    @classmethod
    def name(cls) -> str:
        return "case_index"

    def schema(self) -> str:
        return "court string, year int, page string, title string, url string, date date"

    def reader(self, schema) -> ds.DataSourceReader:
        return IndexReader(self.options)

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return IndexStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
