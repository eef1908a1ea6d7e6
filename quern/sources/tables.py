"""Parquet tables, and the tables that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))


#: A value's band, as in :data:`BUCKET_SQL`.
def value_bucket(v: str = "value"):
    return F.when(F.col(v) < 1, "lt_1").when(F.col(v) < 5, "v_1_5").when(F.col(v) < 15, "v_5_15").when(F.col(v) < 60, "v_15_60").otherwise("v_60_plus")


BUCKET_SQL = "CASE WHEN value < 1 THEN 'lt_1' WHEN value < 5 THEN 'v_1_5' WHEN value < 15 THEN 'v_5_15' WHEN value < 60 THEN 'v_15_60' ELSE 'v_60_plus' END"


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day and install: its version and how often it was opened."""
    e = events(spark, sf_dir)
    return e.groupBy("date", F.col("user_id").alias("install_id")).agg(F.count("*").alias("opens")).withColumn("version", F.concat(F.lit("v1."), F.col("install_id") % 5, F.lit(".0")))


PINGS_SQL = "pings AS (SELECT CAST(ts AS DATE) AS date, user_id AS install_id, count(*) AS opens, 'v1.' || (user_id % 5) || '.0' AS version FROM events GROUP BY ALL)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters: one row for each day, version, signal and bucket."""
    e = events(spark, sf_dir).withColumn("version", F.concat(F.lit("v1."), F.col("user_id") % 5, F.lit(".0")))
    return e.groupBy("date", "version", F.col("event_type").alias("signal"), value_bucket().alias("bucket")).agg(F.count("*").alias("n"))


METRICS_SQL = f"metrics AS (SELECT CAST(ts AS DATE) AS date, 'v1.' || (user_id % 5) || '.0' AS version, event_type AS signal, {BUCKET_SQL} AS bucket, count(*) AS n FROM events GROUP BY ALL)"


def metric_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The installs seen for each day, signal and bucket."""
    e = events(spark, sf_dir)
    return e.select("date", F.col("event_type").alias("signal"), value_bucket().alias("bucket"), F.col("user_id").alias("install_id")).distinct()


USERS_SQL = f"metric_users AS (SELECT DISTINCT CAST(ts AS DATE) AS date, event_type AS signal, {BUCKET_SQL} AS bucket, user_id AS install_id FROM events)"
AS_OF_SQL = "as_of AS (SELECT max(CAST(ts AS DATE)) AS d FROM events)"


def with_as_of(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``as_of``: the last day of the events, which stands for today."""
    return df.join(F.broadcast(events(spark, sf_dir).agg(F.max("date").alias("as_of"))))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records: a signup is the start of a turn and carries no tokens."""
    e = events(spark, sf_dir)
    tokens = F.when(F.col("event_type") == "signup", 0).otherwise(F.floor(F.round(F.col("value") * 100) / 10)).cast("bigint")
    return e.select(
        "event_id", "ts", "date", F.element_at(F.array(*map(F.lit, ("desktop", "cli", "serve"))), (F.col("user_id") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("event_id") % 11 == 0, F.lit("solo")).otherwise(F.concat("event_type", F.lit("/m"), (F.col("event_id") % 7).cast("string"))).alias("model"),
        (F.col("event_type") == "signup").alias("turn"), tokens.alias("total"), F.floor(tokens * 3 / 10).cast("bigint").alias("cache_hit"), F.floor(tokens / 5).cast("bigint").alias("completion"), (F.col("event_id") % 2).alias("requests"),
    )


USAGE_SQL = """usage AS (
  SELECT event_id, ts, date, source, model, turn, total, total * 3 // 10 AS cache_hit, total // 5 AS completion, requests FROM (
    SELECT event_id, ts, CAST(ts AS DATE) AS date, ['desktop', 'cli', 'serve'][user_id % 3 + 1] AS source,
           CASE WHEN event_id % 11 = 0 THEN 'solo' ELSE event_type || '/m' || (event_id % 7) END AS model, event_type = 'signup' AS turn,
           CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(round(value * 100) / 10) AS BIGINT) END AS total, event_id % 2 AS requests FROM events))"""
