"""Sends this package to the executors, whose Python workers need it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="weftgraph-src-"), "weftgraph_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("weftgraph", os.path.relpath(full, _PACKAGE)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
