"""Exact vector search for many queries at once, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that a block holds.
BLOCK = 2048
FOUND = "query bigint, id bigint, score double"


def blocks(vectors: DataFrame, id_col: str, vec_col: str, size: int = BLOCK) -> DataFrame:
    """Vectors with a norm as blocks: (ids, vecs, dims), unit vectors in bytes; blocks hold vectors of one number of dimensions."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for dims, own in p.groupby(p["vec"].map(len)):
                for at in range(0, len(own), size):
                    some = own.iloc[at : at + size]
                    x = np.array(some["vec"].tolist(), np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    x, ids = x[norm > 0] / norm[norm > 0, None], some["id"].to_numpy(np.int64)[norm > 0]
                    if len(ids):
                        yield pd.DataFrame({"ids": [ids.tobytes()], "vecs": [x.tobytes()], "dims": [int(dims)]})

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0 and id is not null")
    return rows.mapInPandas(pack, "ids binary, vecs binary, dims int")


def _best(k: int):
    """The best ``k`` of a block for each query of a block; ties go to smaller ids."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                q, x = (np.frombuffer(v, np.float64).reshape(-1, r.dims) for v in (r.q_vecs, r.vecs))
                q_ids, ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                score = np.round(q @ x.T, 6)
                n = min(k, len(ids))
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :n]
                yield pd.DataFrame({"query": np.repeat(q_ids, n), "id": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def exact(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, score, place): the ``k`` rows with the largest cosine for each query.

    Blocks of queries meet blocks of the corpus; a pair of blocks is one product of matrices and
    leaves ``k`` rows a query, so that is all that is shuffled.
    """
    own = blocks(corpus, id_col, vec_col)
    asked = blocks(queries, id_col, vec_col).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "dims")
    return _merged(own.join(asked, "dims").repartition(F.xxhash64("ids", "q_ids")).select("q_ids", "q_vecs", "ids", "vecs", "dims").mapInPandas(_best(k), FOUND), k)
