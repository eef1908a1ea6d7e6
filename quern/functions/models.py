"""What embedding and re-ranking models have to offer, and stand-ins that need none.

Models are services of others and are not part of this library. A model is wrapped by
``embed_with`` and called once for each Arrow batch.
"""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(ABC):
    dims: int
    model: str

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of ``dims`` numbers for each text."""


class Reranker(ABC):
    @abstractmethod
    def rerank(self, query: str, texts: list[str]) -> list[float]:
        """A score for each text; larger is better."""


class HashEmbedder(Embedder):
    """Signed counts of words by hash: the same in every process, and near for texts that share words."""

    model = "hash"

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            words = pd.util.hash_array(np.array(t.lower().split(), dtype=object), categorize=False) if t.split() else np.zeros(0, np.uint64)
            np.add.at(out[i], (words % self.dims).astype(int), np.where(words >> np.uint64(63), 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def batches(texts: list[str], count: int = 1000, tokens: int = 120_000) -> list[list[str]]:
    """Texts in batches of bounded number and estimated tokens (a quarter of the bytes, and one)."""
    out: list[list[str]] = []
    used = 0
    for t in texts:
        cost = len(t.encode()) // 4 + 1
        if not out or len(out[-1]) >= count or used + cost > tokens:
            out.append([])
            used = 0
        out[-1].append(t)
        used += cost
    return out


def embed_with(rows: DataFrame, embedder: Embedder, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding) of each row, asked for in batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [v for b in batches(p["text"].fillna("").tolist()) for v in embedder.embed(b).tolist()]
            yield pd.DataFrame({"id": p["id"], "embedding": found})

    return rows.selectExpr(f"cast({id_col} as bigint) as id", f"{text_col} as text").mapInPandas(run, "id bigint, embedding array<float>")


class OverlapReranker(Reranker):
    """The share of the query's words that a text holds; a stand-in for a model."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(t.lower().split())) / max(1, len(asked)) for t in texts]


def rerank_with(rows: DataFrame, reranker: Reranker, query_col: str, text_col: str) -> DataFrame:
    """The rows without their texts and with ``second``, the model's score; null where the model fails, so that a first order can stand."""
    kept = [f for f in rows.schema.fields if f.name not in (query_col, text_col)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            second = pd.Series(np.nan, index=p.index, dtype=float)
            for asked, own in p.groupby(query_col):
                for b in batches(own[text_col].fillna("").tolist()):
                    at = own.index[: len(b)]
                    own = own.iloc[len(b) :]
                    try:
                        second[at] = reranker.rerank(asked, b)
                    except Exception as e:  # noqa: BLE001
                        warnings.warn(f"no second order: {e}", stacklevel=1)
            yield p[[f.name for f in kept]].assign(second=second)

    return rows.mapInPandas(run, T.StructType([*kept, T.StructField("second", T.DoubleType())]))
