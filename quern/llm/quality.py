"""Quality scores from random-indexing word vectors and a small neural network.

A text is cut into runs of letters, of digits and of one and the same sign. Words are counted over all documents; those
with at least ``FLOOR`` occurrences, the ``MOST_WORDS`` most frequent of them, are the vocabulary, which so grows with the
corpus up to that number. Every word of it has a vector of its own; rarer words share ``SHARED`` vectors by hash. Runs in capitals,
signs, and runs that repeat the one before have places of their own. Every place has a sparse random index vector, and the
vector of a place is the sum of the index vectors that stand up to two runs around it,
over all documents of the corpus. A document is the mean of its runs' vectors. On labelled
documents, a two-layer network in numpy learns from these means, and a temperature fitted
on rows that the network did not see calibrates its probabilities.

Labels are learned from a bounded sample: about ``per_label`` rows of each label, outside the
held-out fold. Counts and co-occurrence cover all documents. Null and empty texts have the mean
vector 0 and get a score like all others; with fewer than two labels to learn from, every
score is the share of label 1, or one half. Repeated rows are scored alike; extra columns
are ignored, whatever their names; an empty table gives no rows; very long texts are read whole. Of words that are equally frequent
those with the least hashes come first; of several labels of a document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import blobs, folds
from quern.llm import textpack as tp
from quern.llm.store import materialise

CAPITALS = 32  # places of runs in capitals, by length
SIGNS = 256  # of signs, by byte
REPEATED = 4  # of runs that repeat the one before: letters, digits, signs, spare
FIXED = CAPITALS + SIGNS + REPEATED
SHARED = 4096  # of words outside the vocabulary, by hash
#: Occurrences that a word of the vocabulary has at least, and words that it holds at most.
FLOOR, MOST_WORDS = 20, 16_384
DIM = 64
BLOCK = 64  # places that are summed together
#: Words that a task counts before it sends its counts.
HELD = 1 << 20

_CLASS = np.arange(256)
_CLASS[:3] = 3  # 0 to 2 are white space, letters and digits
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2


def runs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run, its place if it is of a fixed kind (else -1), and where each text's runs begin."""
    buf, off = tp.buffers(part["text"])
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    change = np.ones(len(buf), bool)
    change[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    start = np.flatnonzero(change & (kind != 0)) if len(buf) else np.zeros(0, np.int64)
    cuts = np.append(np.flatnonzero(change), len(buf))
    end = cuts[np.searchsorted(cuts, start, side="right")]
    low = buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
    h = tp.hash_ranges(low, start, end)
    place = np.full(len(h), -1)
    kind, length = kind[start], end - start
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    capital = (kind == 1) & (length > 1) & (2 * (upper[end] - upper[start]) > length)
    place[capital] = np.minimum(length[capital], CAPITALS - 1)
    sign = kind > 2
    place[sign] = CAPITALS + kind[sign]
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    place[again] = CAPITALS + SIGNS + np.minimum(kind[again] - 1, 2)
    return h, place, first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, once for each task as long as they are not too many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> None:
        words, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        held[:] = [(words, np.bincount(inverse, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64))]

    def sent() -> pa.RecordBatch:
        words, counts = held.pop()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    for batch in batches:
        for part in tp.slices(batch, "text"):
            h, place, _ = runs(part)
            held.append(np.unique(h[place < 0], return_counts=True))
            if sum(len(x) for x, _ in held) > HELD:
                merged()
                if 2 * len(held[0][0]) > HELD:
                    yield sent()
    if held:
        merged()
        yield sent()


def vocabulary(docs: DataFrame, floor: int = FLOOR, most: int = MOST_WORDS) -> np.ndarray:
    """Sorted hashes of the words of the vocabulary: ``most`` at most."""
    counts = docs.select("text").mapInArrow(tp.task(_count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
    return np.sort(np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()], np.int64).view(np.uint64))


def places(h: np.ndarray, fixed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of every run: fixed ones, then shared ones, then the words of the vocabulary."""
    out = np.where(fixed >= 0, fixed, FIXED + (h % np.uint64(SHARED)).astype(np.int64))
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        own = (fixed < 0) & (words[at] == h)
        out[own] = FIXED + SHARED + at[own]
    return out


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions and signs for each place; those of a word follow from the word."""
    keys = np.concatenate([np.arange(FIXED + SHARED, dtype=np.uint64), words])
    drawn = np.stack([tp.mix(keys * np.uint64(2) + np.uint64(k)) for k in range(2)], axis=1)
    return (drawn % np.uint64(DIM)).astype(np.int64), np.where(drawn >> np.uint64(63) == 1, 1.0, -1.0)


def _cooccur(words):
    """Sums of index vectors around each place, for one task, in blocks of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, signs = index_vectors(words.value)
        size = len(index) * DIM
        total = np.zeros(size)
        for batch in batches:
            for part in tp.slices(batch, "text"):
                h, fixed, first = runs(part)
                place = places(h, fixed, words.value)
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                at, drawn = [], []
                for gap in (1, 2):
                    same = np.flatnonzero(doc[gap:] == doc[:-gap])
                    a, b = place[same], place[same + gap]
                    for x, y in ((a, b), (b, a)):
                        at.append((x[:, None] * DIM + index[y]).ravel())
                        drawn.append(signs[y].ravel())
                total += np.bincount(np.concatenate(at), weights=np.concatenate(drawn), minlength=size)
        blocks = -(-len(index) // BLOCK)
        padded = np.zeros(blocks * BLOCK * DIM, np.float32)
        padded[:size] = total
        rows = padded.reshape(blocks, -1)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["block", "sums"])

    return run


def word_vectors(docs: DataFrame, words) -> np.ndarray:
    """A unit vector for each place, from all documents: of bounded size, five megabytes at most. ``words`` is the broadcast vocabulary."""
    n = FIXED + SHARED + len(words.value)
    out = np.zeros((-(-n // BLOCK), BLOCK * DIM))
    for block, sums in blobs.add(docs.select("text").mapInArrow(tp.task(_cooccur(words)), blobs.SCHEMA), "float32").items():
        out[block] = sums
    vectors = out.reshape(-1, DIM)[:n]
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))  # frequent neighbours count less
    vectors -= vectors.mean(axis=0)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]).astype(np.float32)


def pool(part: pa.RecordBatch, vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean vector of each text, and the logarithm of its length."""
    h, fixed, first = runs(part)
    place, n, all_of = places(h, fixed, words), part.num_rows, len(vectors)
    size = np.diff(first)
    key, times = np.unique(np.repeat(np.arange(n), size) * all_of + place, return_counts=True)
    own = np.searchsorted(key, np.arange(n + 1) * all_of)
    out = np.zeros((n, DIM + 1), np.float32)
    for d in np.flatnonzero(size):
        a, b = own[d], own[d + 1]
        out[d, :DIM] = times[a:b].astype(np.float32) @ vectors[key[a:b] % all_of] / size[d]
    out[:, DIM] = np.log1p(size) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> dict:
    """A network with one hidden layer, by Adam on balanced classes, and its temperature."""
    rng = np.random.Generator(np.random.PCG64(seed))
    if len(np.unique(y)) < 2 or len(y) < 8:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    order = rng.permutation(len(y))
    held, used = order[: max(4, len(y) // 5)], order[max(4, len(y) // 5) :]
    w = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    share = y[used].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
    for _ in range(epochs):
        rng.shuffle(used)
        for k in range(0, len(used), 128):
            i = used[k : k + 128]
            h = np.maximum(z[i] @ w[0] + w[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - y[i, None]) * weight[i, None] / len(i)
            dh = d @ w[2].T * (h > 0)
            g = [z[i].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(axis=0)]
            t += 1
            for j in range(4):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
                w[j] = w[j] - 0.003 * m[j] / (1 - 0.9**t) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = {"mean": mean, "spread": spread, "w": w, "temperature": 1.0}
    logits = _logits(x[held], net)
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(weight[held] * (np.logaddexp(0, logits / c) - y[held] * logits / c)) for c in grid]
    return net | {"temperature": float(grid[int(np.argmin(loss))])}


def _logits(x: np.ndarray, net: dict) -> np.ndarray:
    w = net["w"]
    return (np.maximum((x - net["mean"]) / net["spread"] @ w[0] + w[1], 0) @ w[2] + w[3])[:, 0]


def apply(x: np.ndarray, net: dict) -> np.ndarray:
    if "constant" in net:
        return np.full(len(x), net["constant"])
    return 1 / (1 + np.exp(-np.clip(_logits(x, net) / net["temperature"], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_mod: int = 4, held_out: int = 2, per_label: int = 8000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    fold: Column = folds.remainder("doc_id", held_out_mod) == held_out
    context = docs.sparkSession.sparkContext
    words = context.broadcast(vocabulary(docs))
    vectors = context.broadcast(word_vectors(docs, words))
    wanted = folds.sample(folds.labelled(labels, label_col, fold), "y", per_label).collect()  # bounded by per_label
    y_of = {r.doc_id: r.y for r in wanted}

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([v.tobytes() for v in pool(part, vectors.value, words.value)], pa.binary())], ["doc_id", "vector"])

    # A narrow table (a quarter of a kilobyte a document) that both training and scoring read.
    table = materialise(docs.mapInArrow(tp.task(pooled), "doc_id bigint, vector binary"))
    ids = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(list(y_of), np.int64)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(np.isin(own, ids.value) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)))

    rows = table.mapInArrow(tp.task(chosen), "doc_id bigint, vector binary").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in rows.vector], np.float64).reshape(-1, DIM + 1)
    net = fit(x, np.array([y_of[i] for i in rows.doc_id], np.float64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([np.frombuffer(v, np.float32) for v in batch["vector"].to_pylist()], np.float64).reshape(-1, DIM + 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(apply(got, net))], ["doc_id", "score"])

    out = table.mapInArrow(tp.task(scored), "doc_id bigint, score double")
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
