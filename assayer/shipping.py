"""Sends the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the whole package to the executors once per application, so that Python workers can import it from anywhere."""
    sc = (spark or SparkSession.active()).sparkContext
    root = Path(__file__).resolve().parents[1]
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp()) / "assayer_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "assayer").rglob("*.py")):
            z.write(path, str(path.relative_to(root)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
