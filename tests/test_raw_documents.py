"""Raw documents come back byte for byte; a write that fails leaves nothing."""

import os

import pytest
from pyspark.sql import functions as F

from assayer.sources import raw_documents


def rows(spark):
    raw_documents.register(spark)
    made = [("a1", "BAILII", "http://x/1", bytes(range(256))), ("a2", "BAILII", "http://x/2.PDF", b"%PDF\r\n\x00"), ("a3", "CanLII", None, None)]
    return spark.createDataFrame(made, "id string, source string, url string, content binary").repartition(3)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows(spark).write.format("raw_documents").mode("append").save(path)
    assert files(path) == ["bailii/a1.html", "bailii/a2.pdf", "canlii/a3.html"] and not [d for d in os.listdir(path) if d.startswith("_")]
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    got = {os.path.basename(r["path"]): bytes(r["content"] or b"") for r in back.collect()}
    assert got == {"a1.html": bytes(range(256)), "a2.pdf": b"%PDF\r\n\x00"}  # binaryFile leaves empty files out
    assert (tmp_path / "raw/canlii/a3.html").read_bytes() == b""
    rows(spark).where("id = 'a1'").withColumn("content", F.lit(b"new")).write.format("raw_documents").mode("append").save(path)
    assert len(files(path)) == 3 and (tmp_path / "raw/bailii/a1.html").read_bytes() == b"new"
    rows(spark).where("id = 'a2'").write.format("raw_documents").mode("overwrite").save(path)
    assert files(path) == ["bailii/a2.pdf"]
    rows(spark).limit(0).write.format("raw_documents").mode("overwrite").save(path)
    assert files(path) == []


@pytest.mark.parametrize("bad", [("../up", "s"), (None, "s"), ("ok", "a/b"), ("a1", "bailii")])
def test_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "raw")
    odd = rows(spark).union(spark.createDataFrame([(*bad, None, b"x")], "id string, source string, url string, content binary"))
    with pytest.raises(Exception, match="not a file name|two rows for"):
        odd.write.format("raw_documents").mode("append").save(path)
    assert files(path) == []
