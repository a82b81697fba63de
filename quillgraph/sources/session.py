"""Sessions: sending this package to executors that do not have it, and bounding what Python gets at once."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
BATCH_BYTES = 1 << 21


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory(prefix="quillgraph-")  # the driver serves the file from there
    atexit.register(folder.cleanup)
    path = f"{folder.name}/{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES and a row from now on, or less where the session says so.

    Spark's own bounds, 10,000 rows and 64 MB, count several times in an executor: as vectors outside
    the heap, as Python objects and as results, for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
