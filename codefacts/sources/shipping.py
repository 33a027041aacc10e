"""Bringing this package to the executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_codefacts_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    path = os.path.join(tempfile.mkdtemp(), "codefacts_package.zip")  # the driver's own copy; Spark sends it on
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._codefacts_shipped = True
