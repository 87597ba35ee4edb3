"""How much of a table a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch. A worker holds a batch and what is made of it, several times the bytes; a longer row is a batch of its own.
ROWS, BYTES = 256, 1 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Hand Arrow batches to Python that are bounded in rows and bytes, so that a worker's memory does not grow with the table."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
