"""Operators on keyed and dated rows: windows against each other, gaps, latest rows, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_days(counts: DataFrame, as_of: DataFrame, days: int, columns: list[str]) -> DataFrame:
    """A row for each of the last ``days`` days up to ``as_of``; 0 where ``counts`` has none."""
    calendar = as_of.select(F.explode(F.sequence(F.date_sub("as_of", days - 1), F.col("as_of"))).alias("date"))
    return calendar.join(counts, "date", "left").select("date", *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def against_previous(rows: DataFrame, keys: list[str], days: int, n: str = "n", flat: float = 0.05) -> DataFrame:
    """Sums of the last ``days`` days up to as_of and of as many before, and how they differ; null where there is nothing."""
    now = F.col("date") >= F.date_sub("as_of", days - 1)
    before = (F.col("date") >= F.date_sub("as_of", 2 * days - 1)) & ~now
    out = rows.groupBy(*keys).agg(F.sum(F.when(now, F.col(n))).alias("now_n"), F.sum(F.when(before, F.col(n))).alias("prev_n"))
    change = F.when(F.col("now_n").isNull() | F.col("prev_n").isNull(), "new").when(F.abs(F.col("now_n") - F.col("prev_n")) / F.col("prev_n") < flat, "flat")
    return out.withColumn("change", change.when(F.col("now_n") > F.col("prev_n"), "up").otherwise("down"))


def newest_version(versions: DataFrame, col: str = "version") -> DataFrame:
    """The largest plain version (``v1.2.3``) by its numbers; others are passed over."""
    parts = F.regexp_extract(col, r"^v?(\d+)\.(\d+)\.(\d+)$", 1), F.regexp_extract(col, r"^v?(\d+)\.(\d+)\.(\d+)$", 2), F.regexp_extract(col, r"^v?(\d+)\.(\d+)\.(\d+)$", 3)
    plain = versions.where(F.col(col).rlike(r"^v?\d+\.\d+\.\d+$"))
    return plain.agg(F.max_by(col, F.struct(*(p.cast("int") for p in parts), F.col(col))).alias("newest"))


def first_and_latest(rows: DataFrame, keys: list[str], order: str, first: int, latest: int) -> DataFrame:
    """The first and the latest rows of each key; both ranks share one sort of the partition."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__a", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    return ranked.where((F.col("__a") <= first) | (F.col("__a") > F.col("__n") - latest)).drop("__a", "__n")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that combines on the map side."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in others))


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counters of ``old`` with those of ``new`` added."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(n).alias(n))


def where_given(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows that match every value that is neither empty nor ``all``."""
    for name, value in wanted.items():
        if value not in ("", "all"):
            rows = rows.where(F.col(name) == value)
    return rows


def top_and_other(rows: DataFrame, key: str, n: str, keep: int) -> DataFrame:
    """Adds ``shown``: the key if it is one of the ``keep`` largest over all rows, else ``Other``."""
    totals = rows.groupBy(key).agg(F.sum(n).alias("__t")).orderBy(F.desc("__t"), key).limit(keep).select(key, F.lit(True).alias("__top"))
    return rows.join(F.broadcast(totals), key, "left").withColumn("shown", F.when(F.col("__top"), F.col(key)).otherwise("Other")).drop("__top")


def islands(rows: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a run begins where ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def _cumulated(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts by value, how many rows have that value or a smaller one, and how many there are. What is sorted is a row for each value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys)
    return counts.withColumn("__upto", F.sum("__c").over(w.orderBy(value))).withColumn("rows", F.sum("__c").over(w))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, rows): the upper of the two middle values of each group."""
    return _cumulated(rows, keys, value).groupBy(*keys).agg(F.min(F.when(F.col("__upto") > F.floor(F.col("rows") / 2), F.col(value))).alias("median"), F.max("rows").alias("rows"))


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles of each group, exact, under the given names."""
    at = lambda p: F.min(F.when(F.col("__upto") * 100 >= F.col("rows") * p, F.col(value)))
    return _cumulated(rows, keys, value).groupBy(*keys).agg(*(at(p).alias(name) for name, p in wanted.items()))
