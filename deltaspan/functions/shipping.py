"""Sending this package to the executors."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Once per application; Python workers import the package from what they are sent."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        folder = os.path.realpath(tempfile.mkdtemp(prefix=PACKAGE.name))
        target = os.path.join(folder, f"{PACKAGE.name}_code.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(PACKAGE.parent))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
