"""What the corpus operators share: tables, the shared folder, Arrow limits, text buffers."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import delete, scratch
from ..shipping import ship

#: Most bytes that Spark hands to a Python worker in one Arrow batch. Bounds a worker's memory whatever the row sizes.
ARROW_BATCH_BYTES = "8m"
ARROW_BATCH_ROWS = "4000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow(spark: SparkSession) -> None:
    """Ready the session for Python: hold Arrow batches to a size that fits a worker, as text rows can be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the operator of a cluster sets to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def few(spark: SparkSession) -> int:
    """Files of a table that every core writes its share of: two a core, however many partitions a step has."""
    return max(12, 2 * spark.sparkContext.defaultParallelism)


class Written:
    """A DataFrame written to the shared folder: the lineage ends here, and lost executors cost no recomputation.

    With `files`, the last step's partitions are read one after the other by so many tasks at most, each of which writes a file.
    """

    def __init__(self, df: DataFrame, name: str, files: int | None = None):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Free the space once nothing reads the table any more."""
        delete(self.spark, self.path)


def free(spark: SparkSession) -> None:
    """Spark deletes a finished step's shuffle files once the driver's JVM has collected what refers to them; have that done now.

    Twice, as what Python lets go of reaches the JVM with a delay.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin and the last one's end. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = 1 << 20):
    """Runs of whole rows (first, end) of at most `most` bytes, or one longer row."""
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end
        first = end
