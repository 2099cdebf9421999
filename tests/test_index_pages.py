"""The index source opens only pages that a filter leaves, and streams each page once."""

import datetime as dt
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from assayer.sources import index_pages


@pytest.fixture
def folder(tmp_path):
    for court in ("EWHC", "UKSC"):
        for year in (2018, 2019, 2020):
            for page in (1, 2):
                save(tmp_path / "saved", court, year, page)
    (tmp_path / "saved" / "EWHC" / "notes").mkdir()
    (tmp_path / "saved" / "readme.txt").write_text("no index")
    return tmp_path / "saved"


def save(folder, court, year, page):
    where = folder / court / str(year)
    where.mkdir(parents=True, exist_ok=True)
    rows = [f'<li><a href="/cases/{court}/{year}/{page}{k}.html">Smith v Trust {k} <b>({k} March {year})</b></a></li>' for k in (1, 2)]
    rows += ['<a href="/cases/search">All searches</a>', '<a href="/about.html">About this</a>', '<a href="/cases/x.html">abc</a>']
    rows += [f'<a href="/cases/{court}/{year}/{page}9.html">Odd Day v Trust (31 February {year})</a>']
    (where / f"{page}.html").write_text("".join(rows))


def traced(spark, folder, trace):
    """The source, with a file left in trace for every page that is opened."""

    class Reader(index_pages.IndexReader):
        def open(self, page):
            with open(os.path.join(trace, uuid.uuid4().hex), "w") as f:
                f.write(page.path)
            return super().open(page)

    class Source(index_pages.IndexSource):
        @classmethod
        def name(cls):
            return "traced_index"

        def reader(self, schema):
            return Reader(self.options)

    index_pages.register(spark)
    spark.dataSource.register(Source)
    return spark.read.format("traced_index").option("folder", str(folder)).load()


def test_filters_leave_pages_closed(spark, folder, tmp_path):
    everything = [tuple(r) for r in traced(spark, folder, str(make(tmp_path / "all"))).collect()]
    assert len(everything) == 36 and len(list((tmp_path / "all").iterdir())) == 12
    day = dt.date
    cases = [
        (F.col("court") == "UKSC", lambda r: r[0] == "UKSC", 6),
        (F.col("year").isin(2018, 2020), lambda r: r[1] != 2019, 8),
        ((F.col("date") >= day(2019, 3, 2)) & (F.col("date") < day(2020, 1, 1)), lambda r: day(2019, 3, 2) <= r[5] < day(2020, 1, 1), 4),
        ((F.col("court") == "EWHC") & (F.col("date") == day(2020, 3, 1)) & F.col("title").contains("Smith"), lambda r: r[0] == "EWHC" and r[5] == day(2020, 3, 1), 2),
        ((F.col("year") > 2018) & F.col("title").startswith("Odd"), lambda r: r[1] > 2018 and r[3].startswith("Odd"), 8),
        (F.col("date") < day(1990, 1, 1), lambda r: False, 0),
        ((F.col("court") == "UKSC") | (F.col("year") == 2018), lambda r: r[0] == "UKSC" or r[1] == 2018, 12),
    ]
    for k, (condition, plain, opened) in enumerate(cases):
        trace = make(tmp_path / f"trace{k}")
        got = traced(spark, folder, str(trace)).where(condition).collect()
        assert sorted(map(tuple, got)) == sorted(r for r in everything if plain(r)), condition
        assert len(list(trace.iterdir())) == opened, condition
    odd = next(r for r in everything if r[3].startswith("Odd") and r[1] == 2019)
    assert odd[5] == day(2019, 1, 1) and odd[4].startswith("https://example.invalid/cases/")


def make(path):
    path.mkdir()
    return path


def test_missing_folder_has_no_entries(spark, tmp_path):
    index_pages.register(spark)
    assert spark.read.format("case_index").option("folder", str(tmp_path / "none")).load().collect() == []


def test_stream_reads_each_page_once(spark, folder, tmp_path):
    index_pages.register(spark)

    def run():
        rows = spark.readStream.format("case_index").option("folder", str(folder)).option("settle", "0").load()
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 36
    time.sleep(0.1)
    save(folder, "EWHC", 2021, 1)
    assert run() == 39
    assert run() == 39
