"""The folder that driver and executors share, and tables in it that outlive a step."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder. Only in local mode, where all see it, is one made up."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoints-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        said = got.get()
    return said.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the application ends."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None:  # the session ended before the interpreter
            continue
        try:
            delete(spark, path)
        except Exception as error:
            print(f"not removed: {path}: {error}", file=sys.stderr)


atexit.register(_clear)
