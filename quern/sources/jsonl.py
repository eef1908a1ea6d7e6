"""Line-delimited JSON logs by day: an append sink, a reader of some days, and tolerant decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_days(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends rows below ``day=...`` folders. The commit of a job is atomic, so no line is ever torn."""
    rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def read_days(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Rows of the days from ``first`` to ``last``; other folders are not opened, and lines that can't be decoded are dropped."""
    rows = spark.read.schema(f"{schema}, day string").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("day").between(first, last))


def until_damage(rows: DataFrame, order: str, raw: str, schema: str) -> DataFrame:
    """Records of a strict log up to the first that can't be decoded: its place is one aggregate, and no window over the log."""
    decoded = rows.withColumn("record", F.from_json(raw, schema)).withColumn("bad", F.col("record").isNull() | F.forall(F.array(*(F.col(f"record.{f.split()[0]}").isNull() for f in schema.split(","))), lambda x: x))
    damage = decoded.where("bad").agg(F.min(order).alias("damage"))
    return decoded.join(F.broadcast(damage)).where(F.col("damage").isNull() | (F.col(order) < F.col("damage"))).drop("bad", "damage")


def read_arms(spark: SparkSession, arms: dict[str, str], schema: str) -> DataFrame:
    """Result sets of several arms, one path each, as one table with the arm's name; records may go over several lines."""
    read = lambda name, path: spark.read.schema(schema).json(path).withColumn("arm", F.lit(name))
    return reduce(DataFrame.unionByName, (read(name, path) for name, path in arms.items()))
