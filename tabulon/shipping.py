"""Makes the package importable for Python workers of a session whose executors don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application, unless workers find it on PYTHONPATH."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or str(package.parent) in paths:
        return
    to = os.path.join(tempfile.mkdtemp(prefix="tabulon-"), "tabulon.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)
