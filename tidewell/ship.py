"""The package sent to executors that don't have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's default: texts are long, and a batch is held by the JVM and by Python.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Adds this package to what Python workers import from, once for each application; Spark's own file server hands it out. Batches get smaller, too."""
    name, default, rows = BATCH
    if spark.conf.get(name) == default:
        spark.conf.set(name, rows)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here, folder = Path(__file__).parent, tempfile.mkdtemp(prefix="tidewell-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{here.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
