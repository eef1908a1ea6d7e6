"""Hard negatives by exact integer scores, the Four-Russians way.

Vectors become integers. A candidate is kept as bit planes: for each bit of its components and each eight dimensions, a
byte. For an anchor and eight dimensions, a table has the sums of all 256 subsets of the anchor's components; a
candidate's byte of a plane picks the sum of the components whose bit is set. The sums of a plane's groups are added,
and planes are added up from the highest bit, doubled at each step, which gives the full inner product. The highest plane is that of
the sign and counts as negative.

Candidates stay in blocks, as do anchors, and blocks meet in a grid of cells: each cell is a task's share of both, so
neither side is whole anywhere. Two rounds: the best rows of the same label are the positives (only blocks of one label meet), then bands
below the positives' scores are searched among all other labels. A pair of blocks leaves a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textpack as tp
from quern.llm.store import materialise

#: Vectors in a block of candidates and of anchors, and how many a task keeps for blocks that are not full yet.
BLOCK, ANCHORS, KEPT = 2048, 128, 16_384
#: Sums of eight components stay in 32 bits below this; and what a component may be.
NARROW, WIDEST = 1 << 26, 2.0**52


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of integers (rows, dims) in two's complement, lowest first: (bits, groups of eight dimensions, rows) bytes."""
    bits = max(1, *(int(v if v >= 0 else ~v).bit_length() + 1 for v in (x.max(initial=0), x.min(initial=0))))
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.int64)
    wide[:, : x.shape[1]] = x
    return np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(bits)])


def tables(a: np.ndarray) -> np.ndarray:
    """Sums of all subsets of each eight components of anchors (rows, dims): (groups, 256, rows)."""
    kind = np.int32 if np.abs(a).max(initial=0) < NARROW else np.int64
    wide = np.zeros((len(a), -(-a.shape[1] // 8) * 8), kind)
    wide[:, : a.shape[1]] = a
    t = np.zeros((wide.shape[1] // 8, 256, len(a)), kind)
    for j in range(8):
        t[:, 1 << j : 2 << j] = t[:, : 1 << j] + wide.T.reshape(-1, 8, 1, len(a))[:, j]
    return t


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (rows, anchors) from subset sums and bit planes."""
    bits, groups, rows = packed.shape
    out = np.zeros((rows, table.shape[2]), np.int64)
    plane, picked = (np.empty((rows, table.shape[2]), table.dtype) for _ in range(2))
    for b in range(bits - 1, -1, -1):
        plane[:] = 0
        for g in range(groups):
            plane += np.take(table[g], packed[b, g], axis=0, out=picked, mode="clip")
        out = out * 2 + plane if b < bits - 1 else -plane.astype(np.int64)
    return out


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["x"].tolist(), np.int64).reshape(len(rows), -1)


def _blocks(size: int, by_label: bool, anchors: bool):
    """Rows of one number of dimensions, and one label if asked, as blocks in the order of ids."""
    def block(rows: pd.DataFrame) -> dict:
        x = _vectors(rows)
        out = {"label": int(rows["label"].iloc[0]), "dims": x.shape[1], "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes()}
        body = x if anchors else planes(x)
        out |= {"bits": 0 if anchors else len(body), "body": body.tobytes()}
        if anchors:
            out["positives"] = [r.tolist() if r is not None else [] for r in rows["positives"]] if "positives" in rows else []
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = {}, 0
        for batch in batches:
            batch["dims"] = batch["x"].map(len)
            for key, rows in batch.groupby(["label", "dims"] if by_label else ["dims"]):
                kept.setdefault(key, []).append(rows)
                n += len(rows)
            if n >= KEPT:
                for rows in map(pd.concat, kept.values()):
                    rows = rows.sort_values("vec_id", kind="stable")
                    yield pd.DataFrame([block(rows.iloc[k : k + size]) for k in range(0, len(rows), size)])
                kept, n = {}, 0
        for rows in map(pd.concat, kept.values()):
            rows = rows.sort_values("vec_id", kind="stable")
            yield pd.DataFrame([block(rows.iloc[k : k + size]) for k in range(0, len(rows), size)])

    return run


_BLOCK = "label bigint, dims int, ids binary, labels binary, bits int, body binary"


def _met(candidates: DataFrame, anchors: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """Pairs of blocks of the same keys. Of ``cells`` cells, each candidate block goes to those of a column and each anchor block to those of a row."""
    columns = max(1, round((cells / 28) ** 0.5))  # anchors are a fiftieth of the rows and wider; so both sides are copied to about as many bytes
    rows = max(1, cells // columns)
    own = candidates.withColumn("row", F.pmod(F.xxhash64("ids"), F.lit(rows)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumnsRenamed({"ids": "c_ids", "labels": "c_labels", "bits": "c_bits", "body": "c_body"})
    asked = anchors.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    if "label" not in keys:
        own, asked = own.drop("label"), asked.drop("label")
    return own.join(asked, [*keys, "row", "column"]).drop("row", "column")


def _pair(r) -> tuple[np.ndarray, ...]:
    """Ids and labels of both blocks of a pair, and the scores by anchor."""
    c_ids, c_labels, ids, labels = (np.frombuffer(v, np.int64) for v in (r.c_ids, r.c_labels, r.ids, r.labels))
    packed = np.frombuffer(r.c_body, np.uint8).reshape(r.c_bits, -(-r.dims // 8), len(c_ids))
    score = scores(tables(np.frombuffer(r.body, np.int64).reshape(len(ids), r.dims)), packed)
    return c_ids, c_labels, ids, labels, np.ascontiguousarray(score.T)


def _best(n: int):
    """The ``n`` best other rows of a block for each anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                c_ids, _, ids, _, score = _pair(r)
                order = np.argsort(-score, axis=1, kind="stable")[:, : n + 1 + _most_alike(c_ids)]
                other = c_ids[order] != ids[:, None]
                keep = other & (np.cumsum(other, axis=1) <= n)
                a, k = np.nonzero(keep)
                yield pd.DataFrame({"anchor_id": ids[a], "id": c_ids[order[a, k]], "score": score[a, order[a, k]]})

    return run


def _most_alike(ids: np.ndarray) -> int:
    """How often an id of a block occurs beside once; rows of the anchor's own id are passed over."""
    return int(np.unique(ids, return_counts=True)[1].max()) - 1


def _banded(n: int, low: int, high: int):
    """For each anchor and positive the ``n`` best rows of other labels whose score is in the band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                c_ids, c_labels, ids, labels, score = _pair(r)
                order = np.argsort(-score, axis=1, kind="stable")
                found = []
                for a, pairs in enumerate(r.positives):
                    o = order[a][c_labels[order[a]] != labels[a]]
                    down = -score[a, o]  # ascending
                    for positive, p in pairs.reshape(-1, 2).tolist() if len(pairs) else []:
                        # low*p <= 100*s <= high*p, in whole numbers: s from ceil(low*p/100) to floor(high*p/100)
                        at, to = np.searchsorted(down, -(high * p // 100)), np.searchsorted(down, -(-(-low * p // 100)), side="right")
                        found += [(int(ids[a]), positive, int(c_ids[o[k]]), p, int(-down[k])) for k in range(at, min(to, at + n))]
                yield pd.DataFrame(found, columns=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, label, embedding).

    A component x is floor(scale * x). Anchors are the rows whose vec_id is divisible by ``every``, others those of another
    vec_id. Higher scores come first, then smaller ids. Rows take no part if vec_id, label or vector is null, or a component is null, not
    finite, or beyond 2**52; rows of another number of dimensions than the anchor's are nothing to it, and vectors without
    dimensions score 0. A repeated vec_id is one anchor (of the rows, the one of the least label and vector), and its rows are candidates each. Sums beyond 64 bits wrap
    around. Without anchors there are no rows. Other columns are not read.
    """
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < WIDEST))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(sound).withColumn("x", F.transform("x", lambda c: F.floor(c * scale)))
    anchors = materialise(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x"))
    cells = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = "vec_id", "label", "x"

    asked = anchors.mapInPandas(_blocks(ANCHORS, True, True), _BLOCK)
    pairs = _met(rows.select(*plain).mapInPandas(_blocks(BLOCK, True, False), _BLOCK), asked, ["label", "dims"], cells)
    best = pairs.mapInPandas(_best(positives), "anchor_id bigint, id bigint, score bigint")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = best.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    bands = materialise(found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.array("id", "score")).alias("pairs")))

    asked = anchors.join(bands, "vec_id").select(*plain, F.flatten("pairs").alias("positives"))
    asked = asked.mapInPandas(_blocks(ANCHORS, False, True), _BLOCK + ", positives array<array<bigint>>")
    pairs = _met(rows.select(*plain).mapInPandas(_blocks(BLOCK, False, False), _BLOCK), asked, ["dims"], cells)
    held = pairs.mapInPandas(_banded(negatives, low, high), "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = held.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """The vectors, with the label of each whose vec_id is divisible by ``every`` moved on by one, modulo ``classes``."""
    label = F.col("label").cast("bigint")
    return vectors.select("vec_id", F.when(F.col("vec_id") % every == 0, F.pmod(label + 1, F.lit(classes))).otherwise(label).alias("label"), "embedding")
