"""Arrow batches on their way to Python, bounded by their bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes that a batch holds, or one row. A worker holds several copies of a batch: as Arrow, as Python's objects, and what is made of them.
BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """From now on batches of the session are cut at :data:`BYTES`, so that a worker's memory does not grow with rows or with long texts; Spark's own bounds are 10,000 rows and 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
