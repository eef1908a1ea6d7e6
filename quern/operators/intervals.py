"""Interval algebra over rows with a start and an end, per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that touch or overlap as one (``start <= previous end``)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(end) > F.col(start)).withColumn("__new", F.coalesce(F.col(start) > before, F.lit(True)).cast("int"))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def union_length(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return merge(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))


def overlaps(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Span of each key's intervals, and whether two overlap; touching is no overlap."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    flagged = rows.withColumn("__o", F.coalesce(F.col(start) < F.max(end).over(w), F.lit(False)))
    return flagged.groupBy(*keys).agg((F.max(end) - F.min(start)).alias("span"), F.bool_or("__o").alias("overlap"))


def sweep(rows: DataFrame, keys: list[str], layer: str, layers: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Segments between neighbouring ends, with how many intervals of each layer are open in them.

    One sort for each key; the segments are at most twice the intervals.
    """
    points = rows.select(*keys, layer, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))).alias("p")).select(*keys, layer, "p.at", "p.step")
    steps = points.groupBy(*keys, "at").agg(*(F.sum(F.when(F.col(layer) == x, F.col("step")).otherwise(0)).alias(f"open_{x}") for x in layers))
    w = Window.partitionBy(*keys).orderBy("at")
    opened = reduce(lambda d, x: d.withColumn(f"open_{x}", F.sum(f"open_{x}").over(w)), layers, steps.withColumn("until", F.lead("at").over(w)))
    return opened.where("until is not null").withColumnRenamed("at", start).withColumnRenamed("until", end)


def subtract(base: DataFrame, covered: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """What of ``base`` no interval of ``covered`` covers."""
    both = base.select(*keys, start, end, F.lit("base").alias("__l")).unionByName(covered.select(*keys, start, end, F.lit("covered").alias("__l")))
    left = sweep(both, keys, "__l", ["base", "covered"], start, end).where("open_base > 0 and open_covered = 0")
    return merge(left.select(*keys, start, end), keys, start, end)


def by_priority(rows: DataFrame, keys: list[str], layer: str, layers: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Time of each key that goes to each layer if every moment belongs to the first layer that is open in it."""
    seg = sweep(rows, keys, layer, layers, start, end)
    first = reduce(lambda rest, x: F.when(F.col(f"open_{x}") > 0, x).otherwise(rest), reversed(layers), F.lit("other"))
    seg = seg.withColumn("__first", first).withColumn("__ms", F.col(end) - F.col(start))
    return seg.groupBy(*keys).agg(*(F.sum(F.when(F.col("__first") == x, F.col("__ms")).otherwise(0)).alias(x) for x in [*layers, "other"]))
