"""Sends this package to the Python workers of a cluster, which don't see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Text that Spark hands to Python at once, whatever the rows: 10,000 of them can be of any size.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home).as_posix()}")
    spark.sparkContext.addPyFile(str(target))
    _sent.add(app)


def bound_batches(spark: SparkSession) -> None:
    """BATCH_BYTES for this session's batches, unless it says otherwise itself."""
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):  # as Spark has it, so nobody chose it
        spark.conf.set(BATCH, str(BATCH_BYTES))
