"""Lets Python workers import this package: from the checkout where they share it, else from a copy that Spark ships."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
ROOT = str(PACKAGE.parent)
_shipped: set[str] = set()
#: Whole texts and images travel in small Arrow batches: an executor holds several of them at once, outside its heap.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bound what the session sends Python workers at once."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def can_import(spark: SparkSession) -> None:
    """In one process with the driver: its checkout on the import path. On a cluster: the package as a zip file, once."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        env = context.environment
        if ROOT not in env.get("PYTHONPATH", "").split(":"):
            env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    elif context.applicationId not in _shipped:
        path = f"{tempfile.mkdtemp()}/{PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
