"""A table of vectors that is bound to the recipe by which they were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.lineage import drop


def recipe(chunker: int, model: str, dims: int) -> str:
    return f"chunker={chunker}/model={model}/dims={dims}"


def write(vectors: DataFrame, path: str, made_by: str) -> None:
    """Replaces the vectors of the paths that ``vectors`` holds (dynamic partition overwrite) and leaves all others."""
    vectors.withColumn("recipe", F.lit(made_by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path").parquet(path)


def read(spark: SparkSession, path: str, made_by: str, dims: int) -> DataFrame:
    """Vectors made by this recipe with the right number of dimensions; others are as good as absent."""
    return spark.read.parquet(path).where((F.col("recipe") == made_by) & (F.size("vec") == dims))


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.countDistinct("path").alias("paths"), F.count("*").alias("chunks"))


def delete(spark: SparkSession, path: str, *names) -> None:
    """Takes the vectors of some paths away; their folders are dropped and no file is read."""
    drop(spark, *(f"{path}/path={name}" for name in names))
