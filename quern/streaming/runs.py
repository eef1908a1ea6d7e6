"""Structured Streaming jobs over event files, run until what is there has been read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.lineage import shared_folder


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1) -> DataFrame:
    """The event files of a folder as a stream; ``ts`` as event time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def updates(stream: DataFrame, mode: str = "update", shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Runs a stream over what is there; every batch's rows, as ``shape`` makes them, with its number as ``batch``.

    A batch that is run again replaces its files. A source without a batch gives no rows.
    """
    spark = stream.sparkSession
    base = folder(spark)
    schema: list = []

    def write(df: DataFrame, batch: int) -> None:
        rows = shape(df)
        schema[:] = [rows.schema]
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not schema:
        return shape(spark.createDataFrame([], stream.schema)).withColumn("batch", F.lit(0))
    return spark.read.schema(T.StructType([*schema[0].fields, T.StructField("batch", T.IntegerType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")


def hourly_counts(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; windows that the watermark has passed are forgotten."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def debounced(stream: DataFrame, quiet: str, late: str) -> DataFrame:
    """Bursts of events of a user, put out once, after ``quiet`` without another one; their state goes with the watermark."""
    s = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("began"), "n")


def compacted(log: DataFrame, times: int, least_bytes: int) -> DataFrame:
    """The rows of each log, or where it has grown to ``times`` its live size, and over ``least_bytes``, only the live ones, numbered anew.

    Live is what came with or after the last record that replaces everything (``system``), but for what can be made again (``assistant``).
    """
    w = Window.partitionBy("conv_id")
    base = F.coalesce(F.max(F.when(F.col("role") == "system", F.col("turn"))).over(w), F.lit(0))
    size = F.octet_length("text")
    m = log.withColumn("live", (F.col("turn") >= base) & (F.col("role") != "assistant"))
    m = m.withColumn("log_bytes", F.sum(size).over(w)).withColumn("live_bytes", F.sum(F.when(F.col("live"), size).otherwise(0)).over(w))
    m = m.withColumn("compact", (F.col("log_bytes") > times * F.col("live_bytes")) & (F.col("log_bytes") > least_bytes)).where("live or not compact")
    return m.withColumn("idx", F.row_number().over(w.orderBy("turn")) - 1).withColumn("kind", F.when(F.col("compact"), "snapshot").otherwise("log"))


def latest_update(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last state of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


TURNS = "user_id bigint, turn bigint, n bigint"


def turn_counters(stream: DataFrame, late: str = "2 hours", forget: int = 60 * 86_400_000) -> DataFrame:
    """Events of each turn of each user, with the turn's number and count as state: a signup begins a turn.

    A row is put out for every turn that a batch touches; its last one stands. Input of a
    user is sorted inside its batch. The state of a user who has not been seen for ``forget`` milliseconds of event time goes.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        turn, n = state.get if state.exists else (0, 0)
        done: dict[int, int] = {}
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if kind == "signup":
                turn, n = turn + 1, 0
            n += 1
            done[turn] = n
        state.update((turn, n))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + forget)
        yield pd.DataFrame({"user_id": [key[0]] * len(done), "turn": list(done), "n": list(done.values())})

    return stream.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(fold, TURNS, "turn bigint, n bigint", "update", "EventTimeTimeout")


def merge_counters(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Counters that each batch adds to: a batch is counted by itself and written under its number, so that one that is run again replaces its own; nothing is held as state."""
    counted = updates(stream, "append", lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"))


def first_seen(stream: DataFrame, keys: list[str], window: str = "60 days") -> DataFrame:
    """The first event of each key; what was seen is forgotten when the watermark has passed it by ``window``."""
    return stream.withWatermark("ts", window).dropDuplicatesWithinWatermark(keys).select(*keys)
