"""The package for Python workers that don't have it on their path."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once a Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        home = Path(__file__).resolve().parent
        fd, at = tempfile.mkstemp(prefix="lexicrux-", suffix=".zip")
        os.close(fd)
        atexit.register(lambda: os.path.exists(at) and os.remove(at))
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        sc.addPyFile(at)
        _DONE.add(sc.applicationId)
    return spark
