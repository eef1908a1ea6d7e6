"""One stream to several sinks, each of which takes every batch once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import series
from quern.operators.lineage import drop
from quern.operators.versioned import VersionedTable


class Sink(Protocol):
    """What a stream can go to. A batch may come again if another sink, or the stream, fails after it."""

    def taken(self) -> int: ...

    def take(self, rows: DataFrame, batch: int) -> None: ...


class Files:
    """Rows of each batch in a folder of the batch's number; one that comes again is written over."""

    def __init__(self, path: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.path, self.shape = path, shape

    def taken(self) -> int:
        return -1

    def take(self, rows: DataFrame, batch: int) -> None:
        self.shape(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


class Counters:
    """Counts by keys in a table; the number of the batch is committed with them, so one that comes again is passed over."""

    def __init__(self, table: VersionedTable, keys: list[str], n: str = "n"):
        self.table, self.keys, self.n = table, keys, n

    def taken(self) -> int:
        return self.table.batch()

    def take(self, rows: DataFrame, batch: int) -> None:
        new = rows.groupBy(*self.keys).agg(F.count("*").alias(self.n))
        if not self.table.entries():
            self.table.replace(new, batch)
        else:
            self.table.change(lambda old: series.merge_counts(old, new, self.keys, self.n), batch)


class Latest:
    """The last row of each key in a table."""

    def __init__(self, table: VersionedTable, keys: list[str], order: list[str]):
        self.table, self.keys, self.order = table, keys, order

    def taken(self) -> int:
        return self.table.batch()

    def take(self, rows: DataFrame, batch: int) -> None:
        if not self.table.entries():
            self.table.replace(series.latest(rows, self.keys, self.order).select(*rows.columns), batch)
        else:
            self.table.change(lambda old: series.latest(old.unionByName(rows), self.keys, self.order).select(*old.columns), batch)


def fan_out(stream: DataFrame, sinks: list[Sink | None], checkpoint: str) -> None:
    """Runs a stream over what is there: each batch goes to the sinks in their order, and to none twice.

    A sink that fails stops the stream. When it is started again from ``checkpoint``, the batch comes once more, and sinks that have taken it
    are passed over. Sinks that are None are left out. The batch is written down once for all sinks, and deleted when they have it.
    """
    spark: SparkSession = stream.sparkSession

    def give(rows: DataFrame, batch: int) -> None:
        wanting = [s for s in sinks if s is not None and s.taken() < batch]
        if not wanting:
            return
        held = f"{checkpoint}/held/{batch}"
        rows.write.mode("overwrite").parquet(held)
        kept = spark.read.parquet(held)
        for sink in wanting:
            sink.take(kept, batch)
        drop(spark, held)

    stream.writeStream.option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).foreachBatch(give).start().awaitTermination()
