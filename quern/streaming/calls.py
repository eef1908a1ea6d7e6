"""Calls and their results, announced in two streams, late and more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(calls: DataFrame, results: DataFrame, late: str, limit: str) -> DataFrame:
    """Announcements (key, call, ts, refreshed) beside results (key, call, ts, ms): (key, call, called, answered, ms), with nulls where the other side is missing.

    An outer join of two streams (or tables): a result belongs to announcements of its call up to ``limit`` before it. What has no partner
    comes out when the watermark has passed it, so state is bounded by ``late`` and ``limit``. A refreshed announcement repeats one that is known and is passed
    over, as is what has no call.
    """
    told = calls.where("not coalesce(refreshed, false) and call is not null and ts is not null").select("key", "call", F.col("ts").alias("called"))
    came = results.where("call is not null and ts is not null").select(F.col("key").alias("r_key"), F.col("call").alias("r_call"), F.col("ts").alias("answered"), "ms")
    if calls.isStreaming:
        told, came = told.withWatermark("called", late), came.withWatermark("answered", late)
    near = (F.col("key") == F.col("r_key")) & (F.col("call") == F.col("r_call")) & (F.col("answered") >= F.col("called")) & (F.col("answered") <= F.col("called") + F.expr(f"INTERVAL {limit}"))
    both = told.join(came, near, "full_outer")
    return both.select(F.coalesce("key", "r_key").alias("key"), F.coalesce("call", "r_call").alias("call"), "called", "answered", "ms")


def settled(rows: DataFrame) -> DataFrame:
    """(key, call, called, answered, ms, state) with a row for each result, and for each call whose last announcement none came for.

    The latest announcement before a result is the one that it answers. States are answered, orphan (a result
    that nothing announced) and open. Rows that came twice count once.
    """
    answers = rows.where("answered is not null").groupBy("key", "call", "answered", "ms").agg(F.max("called").alias("called"))
    state = F.when(F.col("called").isNull(), "orphan").otherwise("answered")
    heard = F.col("answered").isNotNull()
    last = rows.where("called is not null").groupBy("key", "call").agg(F.max("called").alias("called"), F.max_by(heard, F.struct("called", heard)).alias("heard"))
    waiting = last.where("not heard")
    return answers.select("key", "call", "called", "answered", "ms", state.alias("state")).unionByName(waiting.select("key", "call", "called", F.lit(None).cast("timestamp").alias("answered"), F.lit(None).cast("bigint").alias("ms"), F.lit("open").alias("state")))


def totals(rows: DataFrame) -> DataFrame:
    """(key, answered, open, orphans, start_delay_ms, tool_ms, orphan_ms): what settled calls add up to; a start delay is from the latest announcement to the start of the work."""
    delay = (F.unix_millis("answered") - F.col("ms")) - F.unix_millis("called")
    return rows.groupBy("key").agg(
        F.count_if(F.col("state") == "answered").alias("answered"), F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "orphan").alias("orphans"),
        F.coalesce(F.sum(F.when((F.col("state") == "answered") & (delay >= 0), delay)), F.lit(0)).cast("bigint").alias("start_delay_ms"), F.coalesce(F.sum("ms"), F.lit(0)).cast("bigint").alias("tool_ms"),
        F.coalesce(F.sum(F.when(F.col("state") == "orphan", F.col("ms"))), F.lit(0)).cast("bigint").alias("orphan_ms"),
    )
