"""Nearest neighbours by an index of lists and product-quantised residuals, with exact scores at the end.

The index has about as many lists as the root of the number of rows, so a list holds about as many rows. A row lies in
the list of its nearest centre, as its id and a code: a byte for each few dimensions of what the centre leaves. A
query reads the codes of the lists nearest to it, which are a small part of the vectors' bytes, and only the rows that
the codes put first are looked up as vectors and scored again. How many lists that are is measured when the index is
made: as many as hold the wanted share of the true neighbours of a sample of rows.

Lists that follow each other lie together in blocks, and blocks of queries meet blocks of codes: such a pair leaves one
short result for each query, not one for each of its lists.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import ann
from quern.operators.lineage import cut

#: Rows of a sample for each list, rows that the driver trains on at most.
PER_LIST, SAMPLE = 64, 16_384
#: Rows that the lists of a group hold together, of a block of codes at most, queries of a block, and parts of the queries that meet a block in tasks of their own.
GROUPED, BLOCK, ASKED, PARTS = 32_768, 65_536, 128, 16
#: Dimensions of a code's byte, code words, and rows whose neighbours tell how many lists to read.
WIDTH, WORDS, PROBED = 4, 256, 64
DRAW = 1_000_000


@dataclass
class Model:
    """Centres of lists, code words of each group of dimensions, how many lists a query reads, and how many make a group."""

    centres: np.ndarray
    words: np.ndarray
    probes: int
    span: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def near(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists nearest to each row, nearest first."""
        return np.argsort(_far(x, self.centres), axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _far(x, self.centres).argmin(axis=1)
        rest = _padded(x - self.centres[lists])
        return lists, np.stack([_far(rest[:, g], words).argmin(axis=1) for g, words in enumerate(self.words)], axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        rest = np.stack([words[codes[:, g]] for g, words in enumerate(self.words)], axis=1).reshape(len(codes), -1)
        return self.centres[lists] + rest[:, : self.dims]

    def save(self, spark: SparkSession, path: str) -> None:
        shape = json.dumps({"dims": self.dims, "words": self.words.shape, "probes": self.probes, "span": self.span})
        spark.createDataFrame([(shape, self.centres.tobytes(), self.words.tobytes())], "shape string, centres binary, words binary").coalesce(1).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        r = spark.read.parquet(f"{path}/model").first()
        shape = json.loads(r["shape"])
        return cls(np.frombuffer(r["centres"]).reshape(-1, shape["dims"]), np.frombuffer(r["words"]).reshape(shape["words"]), shape["probes"], shape["span"])


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centres."""
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def _padded(x: np.ndarray) -> np.ndarray:
    """Rows as groups of dimensions."""
    groups = -(-x.shape[1] // WIDTH)
    return np.pad(x, ((0, 0), (0, groups * WIDTH - x.shape[1]))).reshape(len(x), groups, WIDTH)


def kmeans(x: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """At most ``n`` centres of rows; one that loses all its rows takes the row that is farthest from its own."""
    rng = np.random.Generator(np.random.PCG64(seed))
    c = np.unique(x[rng.permutation(len(x))[: 4 * n]], axis=0)
    c = c[rng.permutation(len(c))[:n]]
    for _ in range(rounds):
        far = _far(x, c)
        near = far.argmin(axis=1)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        lost = np.flatnonzero(count == 0)
        if len(lost):
            c[lost] = x[np.argsort(-(far[np.arange(len(x)), near] + (x * x).sum(axis=1)), kind="stable")[: len(lost)]]
    return c


def _units(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows that have a norm, as unit vectors; in numpy, since an expression over the elements of an array takes a hundred times as long."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                size = pc.list_value_length(b["vec"]).to_numpy()
                start = np.append(0, np.cumsum(size))
                x = b["vec"].flatten().to_numpy(zero_copy_only=False)  # a null is no number
                norm = np.sqrt(np.add.reduceat(x * x, start[:-1]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    vec = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x / np.repeat(norm, size)))
                yield pa.RecordBatch.from_arrays([b["id"], vec], ["id", "vec"]).filter(pa.array((norm > 0) & np.isfinite(norm)))

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    return rows.mapInArrow(unit, "id bigint, vec array<double>")


def _array(vecs) -> np.ndarray:
    return np.array(list(vecs), np.float64)


def fit(vectors: DataFrame, k: int = 10, target: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> Model | None:
    """Lists in proportion to the root of the rows, trained in two levels on a sample of 64 rows a list; None without rows.

    The driver trains the first level (the fourth root of the rows) and the code words on 16,384 rows at most; the lists
    under each first centre are trained in tasks of Spark. Rows of the most frequent number of dimensions count.
    """
    rows = _units(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return None
    dims, n = sizes[0]["dims"], sizes[0]["count"]
    lists = int(np.ceil(n**0.5))
    draw = F.pmod(F.xxhash64("id", F.lit("index")), F.lit(DRAW))
    sample = cut(rows.where(F.size("vec") == dims).withColumn("draw", draw).where(F.col("draw") <= int(DRAW * min(1.0, PER_LIST * lists / n))))
    x = _array(r["vec"] for r in sample.orderBy("draw", "id").limit(SAMPLE).collect())
    first, of = kmeans(x, int(np.ceil(lists**0.5))), sample.count()

    def cell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"cell": _far(_array(p["vec"]).reshape(-1, dims), first).argmin(axis=1), "vec": p["vec"]})

    def lists_of(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"centre": list(kmeans(_array(rows["vec"]), max(1, round(lists * len(rows) / of))))})

    centres = _array(r["centre"] for r in sample.mapInPandas(cell, "cell int, vec array<double>").groupBy("cell").applyInPandas(lists_of, "centre array<double>").collect())
    rest = _padded(x - centres[_far(x, centres).argmin(axis=1)])
    words = [kmeans(rest[:, g], min(WORDS, len(x))) for g in range(rest.shape[1])]
    most = max(map(len, words))
    model = Model(centres, np.stack([np.pad(w, ((0, most - len(w)), (0, 0)), mode="edge") for w in words]), len(centres), int(np.ceil(len(centres) * min(1, GROUPED / n))))
    model.probes = _probes(model, sample, rows.where(F.size("vec") == dims), k, target)
    return model


def _probes(model: Model, sample: DataFrame, rows: DataFrame, k: int, target: float) -> int:
    """The number of nearest lists that hold ``target`` of the true neighbours of a few rows."""
    few = sample.orderBy(F.desc("draw"), "id").limit(PROBED).select("id", "vec")
    true = ann.exact(rows, few, k, "id", "vec").select("query", "id")
    true = rows.join(F.broadcast(true), "id").select("query", "vec").collect()  # ten rows for each of a few
    asked = {r["id"]: r["vec"] for r in few.collect()}
    place = np.empty((len(asked), len(model.centres)), np.int64)
    np.put_along_axis(place, model.near(_array(asked.values()), len(model.centres)), np.arange(len(model.centres))[None, :], axis=1)
    number = {i: n for n, i in enumerate(asked)}
    lists, _ = model.encode(_array(r["vec"] for r in true))
    return int(np.quantile(place[[number[r["query"]] for r in true], lists], target, method="higher")) + 1


def build(vectors: DataFrame, path: str, model: Model, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Writes the codes of all rows in the order of their lists, in blocks of bounded size that hold lists of one group; a list that has grown large is many blocks, in many tasks."""
    dims = model.dims

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                lists, codes = model.encode(_array(p["vec"]).reshape(-1, dims))
                yield pd.DataFrame({"list": lists, "id": p["id"], "code": [c.tobytes() for c in codes]})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            p = p.assign(group=p["list"] // model.span)
            p = p if held is None else pd.concat([held, p])
            last = p["group"].iloc[-1] if len(p) else None
            held = p[p["group"] == last]  # its end may be in the next batch
            for done in [p[p["group"] != last], *([held] if len(held) >= BLOCK else [])]:
                yield from _cut(done)
            held = None if len(held) >= BLOCK else held
        if held is not None:
            yield from _cut(held)

    def _cut(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for group, own in p.groupby("group"):
            for at in range(0, len(own), BLOCK):
                some = own.iloc[at : at + BLOCK]
                yield pd.DataFrame({"group": [int(group)], "lists": [some["list"].to_numpy(np.int32).tobytes()], "ids": [some["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(some["code"])], "rows": [len(some)]})

    # Written first, so that the bounds of the ranges are not drawn from vectors that are encoded for it.
    rows = cut(_units(vectors, id_col, vec_col).where(F.size("vec") == dims).mapInPandas(coded, "list int, id bigint, code binary"))
    rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInPandas(packed, "group int, lists binary, ids binary, codes binary, rows int").write.parquet(f"{path}/codes")
    model.save(vectors.sparkSession, path)


def search(path: str, vectors: DataFrame, queries: DataFrame, k: int, again: int = 10, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, id, score, place): of the rows that the codes put first, ``again`` times ``k`` for each query, those of the largest exact cosine.

    Queries of other dimensions, without a norm or without an id find nothing. ``probes`` stands for what the index has measured.
    """
    spark = vectors.sparkSession
    model = Model.load(spark, path)
    n = min(len(model.centres), probes or model.probes)
    m, deal = again * k, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(first=model.near(_array(p["vec"]).reshape(-1, model.dims), 1).ravel())

    def met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of queries for each group that holds a list of theirs, with which lists each query reads."""
        for p in parts:
            x, ids = _array(p["vec"]).reshape(-1, model.dims), p["id"].to_numpy(np.int64)
            for at in range(0, len(p), ASKED):
                q, q_ids = x[at : at + ASKED], ids[at : at + ASKED]
                reads = np.zeros((len(q), len(model.centres)), bool)
                np.put_along_axis(reads, model.near(q, n), True, axis=1)
                rows = []
                for group in np.unique(np.flatnonzero(reads.any(axis=0)) // model.span):
                    own = reads[:, group * model.span : (group + 1) * model.span]
                    some = own.any(axis=1)
                    rows.append((int(group), zlib.crc32(q_ids.tobytes()) % PARTS, q_ids[some].tobytes(), q[some].tobytes(), own[some].tobytes()))
                yield pd.DataFrame(rows, columns=["group", "part", "q_ids", "q_vecs", "reads"])

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                yield _first(model, r, m)

    # Near queries stand in one block, so that they read the same groups.
    asked = cut(_units(queries, id_col, vec_col).where(F.size("vec") == model.dims).mapInPandas(nearest, "id bigint, vec array<double>, first int"))
    blocks = asked.repartitionByRange("first", "id").sortWithinPartitions("first", "id").mapInPandas(met, "group int, part int, q_ids binary, q_vecs binary, reads binary")
    codes = spark.read.parquet(f"{path}/codes").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # Few bytes, but much work: dealt to a given number of tasks, which Spark does not put together.
    pairs = codes.repartition(deal, "group", "part").join(blocks.repartition(deal, "group", "part"), ["group", "part"]).select("group", "lists", "ids", "codes", "q_ids", "q_vecs", "reads")
    best = Window.partitionBy("query").orderBy(F.desc("about"), "id")
    likely = pairs.mapInPandas(first, "query bigint, id bigint, about double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= m).select("query", "id")
    own = _units(vectors, id_col, vec_col).where(F.size("vec") == model.dims)
    scored = own.join(likely, "id").join(asked.select(F.col("id").alias("query"), F.col("vec").alias("q_vec")), "query")
    found = scored.select("query", "id", "vec", "q_vec").mapInArrow(_cosines, "query bigint, id bigint, score double").withColumn("score", F.round("score", 6))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products of two columns of vectors, all of the same number of dimensions."""
    for b in batches:
        if b.num_rows:
            x, q = (b[c].flatten().to_numpy().reshape(b.num_rows, -1) for c in ("vec", "q_vec"))
            yield pa.RecordBatch.from_arrays([b["query"], b["id"], pa.array(np.einsum("rd,rd->r", x, q))], ["query", "id", "score"])


def _first(model: Model, r, m: int) -> pd.DataFrame:
    """Of a block of codes the ``m`` rows that they put first for each query of a block, among the lists that it reads; ties go to smaller ids."""
    q_ids, ids, lists = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.lists, np.int32)
    q, reads = np.frombuffer(r.q_vecs).reshape(-1, model.dims), np.frombuffer(r.reads, bool).reshape(len(q_ids), -1)
    x = model.decode(lists, np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1))
    about = np.full((len(q), len(ids)), -np.inf)
    ends = np.flatnonzero(np.append(lists[1:] != lists[:-1], True)) + 1
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        some = reads[:, lists[a] - r.group * model.span]
        if some.all():
            about[:, a:b] = q @ x[a:b].T
        elif some.any():
            about[some, a:b] = q[some] @ x[a:b].T
    least = np.partition(about, -m, axis=1)[:, -m] if m < len(ids) else np.full(len(q), -np.inf)
    query, row = np.nonzero((about >= least[:, None] - 1e-9) & (about > -np.inf))
    score = np.round(about[query, row], 9)
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < m
    return pd.DataFrame({"query": q_ids[query[kept]], "id": ids[row[kept]], "about": score[kept]})
