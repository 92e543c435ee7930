"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="veilwork-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/veilwork.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"veilwork/{p.relative_to(root)}")
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
