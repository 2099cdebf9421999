"""Queries run from another folder: Python workers get the package from the driver alone."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
queries = e.queries()
for name in ("op3_quality_rules", "pearson_interval", "page_paragraphs", "token_segments"):
    if name in queries:
        assert queries[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1, name
print("all ran")
"""


def test_python_workers_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "all ran" in done.stdout, done.stderr[-2000:]
