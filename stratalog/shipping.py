"""Puts this package where Python workers find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, unless PYTHONPATH already names its folder."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="stratalog-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/stratalog", "zip", root, "stratalog"))
    _SHIPPED.add(app)
