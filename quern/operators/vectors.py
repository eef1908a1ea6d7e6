"""Exact vector search with array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_int(a: Column, b: Column) -> Column:
    """Of vectors in bytes; the products are wider than a byte."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def quantise(v: Column, scale: float = 127) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * scale))).cast("tinyint"))


def candidates(k: int, factor: int = 6, most: int = 200) -> int:
    """How many rows to look at again for ``k`` results."""
    return max(k, min(k * factor, most))


def topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", col: str = "embedding", digits: int = 6) -> DataFrame:
    """The ``k`` rows with the largest cosine to ``query``; rows with no norm or other dimensions are passed over.

    The query is a literal, so this is one scan with a bounded heap in each task.
    """
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    if k <= 0 or norm == 0:
        return vectors.withColumn("score", F.lit(0.0)).limit(0).drop(col)
    q = F.array(*(F.lit(float(x)) for x in query))
    own = F.sqrt(dot(F.col(col), F.col(col)))
    scored = vectors.where(F.size(col) == len(query)).withColumn("own", own).where("own > 0")
    return scored.withColumn("score", F.round(dot(F.col(col), q) / (F.col("own") * norm), digits)).drop("own", col).orderBy(F.desc("score"), id_col).limit(k)
