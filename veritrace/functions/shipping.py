"""Makes this package importable in Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
#: Files that a worker holds at once.
BATCH_ROWS = 200


def ship_files(spark: SparkSession) -> None:
    """ship(), for functions of whole files: a batch holds BATCH_ROWS of them at most, or as few as the session asks for."""
    ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="veritrace-code-"), "veritrace-code.zip")
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
