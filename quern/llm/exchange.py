"""Sending many small integers between tasks as bytes.

Rows of (number, document) are packed into one row for each slice of the input and each
place they go to: the lowest bytes of all numbers first, then the next ones, so that
what is alike compresses. Documents go as differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textpack as tp

#: Of marks: bits for each id, hashes, bits of a block, and the most ids that are marked (32 MB).
BITS_EACH, HASHES, BLOCK_BITS = 16, 3, 1 << 16
MOST_MARKED = 1 << 24


def planes(x: np.ndarray, n: int) -> bytes:
    """The lowest ``n`` bytes of 64-bit integers, all first bytes first."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def unplanes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(n, -1).T
    return out.view("<u8")[:, 0]


def pack_docs(doc: np.ndarray) -> bytes:
    return planes(np.diff(doc, prepend=0), 8)


def unpack_docs(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, 8).view(np.int64))


def place(doc: np.ndarray, n: int) -> np.ndarray:
    """A place below ``n`` for each document."""
    return (tp.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x)) if len(x) else np.zeros(1, np.int64)


class Marks:
    """A blocked Bloom filter of ids: tells of most ids outside a set that they are, and never misses one inside."""

    def __init__(self, blocks: int, bits: np.ndarray):
        self.blocks, self.bits = blocks, bits

    def marked(self, doc: np.ndarray) -> np.ndarray:
        out = np.ones(len(doc), bool)
        base = place(doc, self.blocks) * BLOCK_BITS
        for k in range(HASHES):
            at = base + _spot(doc, k)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _spot(doc: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th bit of an id in its block."""
    h = tp.mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (h >> np.uint64(16 * k) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    doc = rows["id"].to_numpy(np.int64)
    bits = np.zeros(BLOCK_BITS, bool)
    for k in range(HASHES):
        bits[_spot(doc, k)] = True
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _blocks(n_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch["id"].to_numpy(), n_blocks)), batch["id"]], ["block", "id"])

    return run


def marks(ids: DataFrame, limit: int = MOST_MARKED) -> Broadcast | None:
    """Marks of the integers in the first column of ``ids``, of a size that grows with their number; none above ``limit`` of them."""
    ids = ids.select(F.col(ids.columns[0]).alias("id")).where("id is not null")
    n = ids.count()
    if n > limit:
        return None
    n_blocks = max(1, -(-n * BITS_EACH // BLOCK_BITS))
    packed = np.zeros((n_blocks, BLOCK_BITS // 8), np.uint8)
    for r in ids.mapInArrow(tp.task(_blocks(n_blocks)), "block bigint, id bigint").groupBy("block").applyInPandas(_block, "block bigint, bits binary").collect():
        packed[r.block] = np.frombuffer(r.bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(Marks(n_blocks, packed.ravel()))


def _keep(found: Broadcast, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            hit = found.value.marked(batch["doc_id"].fill_null(0).to_numpy()) & valid
            yield batch.filter(pa.array(hit == wanted))

    return run


def parted(docs: DataFrame, ids: DataFrame, limit: int = MOST_MARKED):
    """A function ``rows(among, *steps, schema)`` of the rows of ``docs`` whose ``doc_id`` may be in the first column of ``ids``, or of all others.

    Up to ``limit`` ids a filter of bounded size is sent to the executors, so that rows stay where they
    are; beyond it ``docs`` is joined to the ids. Either way all rows whose id is among ``ids`` are told to be so,
    and those without an id are not; with the filter a few others may be told so. ``steps`` go over
    the Arrow batches of the chosen rows and give rows of ``schema``.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("doc_id")).where("doc_id is not null")
    found = marks(ids, limit)

    def rows(among: bool, *steps, schema=None) -> DataFrame:
        if found is not None:
            return docs.mapInArrow(tp.task(_keep(found, among), *steps), schema or docs.schema)
        chosen = docs.join(ids, "doc_id", "left_semi" if among else "left_anti")
        return chosen.mapInArrow(tp.task(*steps), schema) if steps else chosen

    return rows
