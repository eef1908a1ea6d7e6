"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def labelled(labels: DataFrame, label_col: str, fold: Column) -> DataFrame:
    """(doc_id, y) for the labels 0 and 1 of documents outside the held-out fold; of several labels of a document, the largest."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    return rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(rows: DataFrame, group: str, per_group: int, id_col: str = "doc_id") -> DataFrame:
    """About ``per_group`` rows of each group, chosen by a hash of their ids; all rows of a smaller group."""
    counts = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col(group) == F.lit(value)) & (draw < F.lit(int(min(1.0, per_group / n) * 1_000_000))))
    return rows.where(keep)
