"""Logs read back up to the first record that cannot be trusted, or to a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a log and records that are read at most.
MOST_BYTES, MOST_RECORDS = 128 << 20, 100_000
VERSION = 1


def stops(records: DataFrame, most_bytes: int = MOST_BYTES, most_records: int = MOST_RECORDS, version: int = VERSION) -> DataFrame:
    """Adds ``why``: what is wrong with a record, and ``live``: whether it is part of what the log says in the end.

    Records are (log, seq, kind, idx, n, bytes, version, sound). A ``replace`` puts its ``n`` messages in the place of all before; an ``append``
    adds them and says in ``idx`` how many there were. The first record with a reason ends the log: ``damaged`` (it is not sound, or appends to
    another number of messages), ``unsupported`` (another version or kind: someone newer wrote it), or ``records`` (one more than the limit). A log of more than ``most_bytes`` is not read
    at all (``bytes``). Only the first reason counts, so messages are counted as if there were none before it.
    """
    log = Window.partitionBy("log")
    order = log.orderBy("seq")
    r = records.withColumn("pos", F.row_number().over(order)).withColumn("log_bytes", F.sum("bytes").over(log))
    r = r.withColumn("base", F.max(F.when(F.col("kind") == "replace", F.col("pos"))).over(order))
    held = F.coalesce(F.sum("n").over(Window.partitionBy("log", "base").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    why = (
        F.when(F.col("log_bytes") > most_bytes, "bytes").when(~F.coalesce("sound", F.lit(False)), "damaged").when(~F.col("version").eqNullSafe(F.lit(version)), "unsupported")
        .when(F.col("pos") > most_records, "records").when((F.col("kind") == "append") & ~F.col("idx").eqNullSafe(held), "damaged").when(~F.coalesce(F.col("kind").isin("replace", "append"), F.lit(False)), "unsupported")
    )
    r = r.withColumn("why", why).withColumn("stop", F.coalesce(F.min(F.when(F.col("why").isNotNull(), F.col("pos"))).over(log), F.lit((1 << 31) - 1)))
    last = F.coalesce(F.max(F.when(F.col("pos") < F.col("stop"), F.col("base"))).over(log), F.lit(0))
    return r.withColumn("live", (F.col("pos") < F.col("stop")) & (F.col("pos") >= last)).drop("base")


def replay(records: DataFrame, most_bytes: int = MOST_BYTES, most_records: int = MOST_RECORDS, version: int = VERSION) -> DataFrame:
    """(log, records, messages, bytes, reason, stopped_at) of each log: what was read, what is live, and why reading ended (``end`` if nothing stopped it), at which seq."""
    r = stops(records, most_bytes, most_records, version)
    first = F.col("pos") == F.col("stop")
    return r.groupBy("log").agg(
        F.count_if(F.col("pos") < F.col("stop")).alias("records"), F.coalesce(F.sum(F.when(F.col("live"), F.col("n"))), F.lit(0)).cast("bigint").alias("messages"),
        F.coalesce(F.sum(F.when(F.col("live"), F.col("bytes"))), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.max(F.when(first, F.col("why"))), F.lit("end")).alias("reason"), F.max(F.when(first, F.col("seq"))).alias("stopped_at"),
    )
