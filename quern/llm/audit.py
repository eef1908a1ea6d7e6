"""What filters do to each other: counts of every order of five filters, by sorted posting lists.

A filter's posting list holds the failing documents of a part in the order of their ids. Documents are dealt into
ranges of (part, id), so a list is cut at the same ids as all others, and a range of every list is merged in one
place, however large a part is. In a range, unions and differences of lists gallop: the shorter list is looked up in the
longer one, in order, so each lookup starts where the last one ended. Their sizes add up over the ranges of a part.
What a filter removes after others depends on which these are, not on their order: 16 sets of others for each of
five filters are merged, and all 120 orders read their steps off those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import textpack as tp
from quern.llm.store import materialise

FILTERS = "ABCDE"
#: Documents of a range whose lists are merged at once.
RANGE_ROWS = 65_536
#: Failure conditions of A to D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"

_CAPITAL, _SYMBOL, _FIRST = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_FIRST[128:192] = False  # bytes that go on a character


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of A to D of whole texts, and a digest that tells texts apart."""
    for batch in batches:
        for part in tp.slices(batch, "text"):
            buf, off = tp.buffers(part["text"])
            raw, at = buf.tobytes(), off.tolist()
            texts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            words = [t.split() for t in texts]  # of bytes: at the six ASCII spaces
            n = np.fromiter(map(len, words), np.int64, len(words))
            distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
            capitals, symbols, points = (np.diff(np.concatenate([[0], np.cumsum(c[buf], dtype=np.int64)])[off]) for c in (_CAPITAL, _SYMBOL, _FIRST))
            fails = (n < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * n) * 2 + (100 * capitals > MOST_CAPITALS * points) * 4 + (symbols > 0) * 8
            digest = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["part"], pa.array(fails.astype(np.int32)), digest], ["doc_id", "part", "fails", "digest"])


def flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails): a row for each document, with bit k of ``fails`` set if it fails the k-th filter.

    E fails a text that a smaller doc_id has, of all parts; a row without a doc_id is neither smaller nor larger than others. Texts are told apart by 128
    bits. Only (doc_id, digest) is shuffled; the largest groups of copies are split by the skew join.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    read = materialise(rows.mapInArrow(tp.task(_read), "doc_id bigint, part string, fails int, digest binary"))
    copied = materialise(read.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"))
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return read.join(copied, "digest", "left").select("doc_id", "part", (F.col("fails") + later.cast("int") * 16).alias("fails"))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What of the sorted list ``a`` is not in the sorted list ``b``; the shorter one is looked up in the longer."""
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return a[(at == len(b)) | (b[np.minimum(at, len(b) - 1)] != a)] if len(b) else a
    at = np.searchsorted(a, b)
    hit = at[(at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)]
    return np.delete(a, hit)


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Of sorted lists, the shortest first: what is new of each is put where the lookup found its place."""
    out = np.zeros(0, np.int64)
    for own in sorted(lists, key=len):
        few, many = (own, out) if len(own) <= len(out) else (out, own)
        new = minus(few, many)
        out = np.insert(many, np.searchsorted(many, new), new)
    return out


#: Sets of filters as bits: each filter, and those that stand before it.
STEPS = [(f, sum(1 << g for g in before)) for f in range(len(FILTERS)) for k in range(len(FILTERS)) for before in combinations([g for g in range(len(FILTERS)) if g != f], k)]
COUNTS = ["total", "failing", "removed", "good_lost", "toxic_lost", "gone"]


def merge(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, total: int) -> list[tuple[int, ...]]:
    """For each step (filter, those before): documents, failing, removed, good and toxic among these, and gone after it."""
    gone = {0: np.zeros(0, np.int64)}
    for s in range(1, 1 << len(lists)):
        gone[s] = union([lists[k] for k in range(len(lists)) if s >> k & 1])
    out = []
    for f, before in STEPS:
        removed = minus(lists[f], gone[before])
        lost = [len(removed) - len(minus(removed, x)) for x in (good, toxic)]
        out.append((f, before, total, len(lists[f]), len(removed), *lost, len(gone[before | 1 << f])))
    return out


def _range(part: np.ndarray, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """Merged counts of the parts of a range; rows are in the order of part and doc_id, and are known by their place."""
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        lists = [np.flatnonzero(fails[a:b] >> k & 1) for k in range(len(FILTERS))]
        for row in merge(lists, np.flatnonzero(good[a:b]), np.flatnonzero(toxic[a:b]), b - a):
            yield part[a], *row


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    names = ["part", "filter", "before", *COUNTS]

    def some(kept: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(kept)
        part = t["part"].to_numpy()
        for name, f, before, *counts in _range(part, *(t[c].to_numpy() for c in ("fails", "good", "toxic"))):
            key = (name, f, before)
            sums[key] = sums.get(key, 0) + np.array(counts, np.int64)

    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= RANGE_ROWS:
            some(kept)
            kept, n = [], 0
        if len(sums) > 100_000:  # of many parts, those behind are done
            yield _rows(sums, names)
            sums.clear()
    if n:
        some(kept)
    if sums:
        yield _rows(sums, names)


def _rows(sums: dict[tuple, np.ndarray], names: list[str]) -> pa.RecordBatch:
    keys = list(zip(*sums, strict=True))
    counts = np.array(list(sums.values())).T
    return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), *map(pa.array, counts)], names)


def _orders(spark: SparkSession) -> DataFrame:
    """The steps of all orders: filter_order, step, filter, before. 600 rows."""
    rows = [("".join(FILTERS[f] for f in o), k + 1, o[k], sum(1 << g for g in o[:k])) for o in permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part and order.

    Parts are the values of ``lang``; null counts as the empty string. Every row of ``docs`` is a document, repeated ones
    and those without a doc_id too; of several labels of a doc_id, one that is 1 counts. Null texts are empty. Without documents there are no parts and no rows. Other columns are not read.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = flags(docs).join(known, "doc_id", "left").select("part", "doc_id", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    ranges = materialise(rows).repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    schema = "part string, filter int, before int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    merged = ranges.select("part", "fails", "good", "toxic").mapInArrow(tp.task(_merged), schema)
    steps = materialise(merged.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    others = F.expr(f"{(1 << len(FILTERS)) - 1} - shiftleft(1, filter)")
    size = F.bit_count("before").cast("int")
    weights = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), size + 1)
    filters = steps.groupBy("part", "filter").agg(F.sum(weights * F.col("removed")).cast("bigint").alias("shapley"), F.sum(F.when(F.col("before") == others, F.col("removed"))).cast("bigint").alias("unique_fails"))
    return (
        steps.join(filters, ["part", "filter"]).join(F.broadcast(_orders(docs.sparkSession)), ["filter", "before"])
        .select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
