"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item (the whole item if it
has fewer). A window occurs in a document if all of its shingles do, at the right
places, so the join is one of containment: of a window's shingles, ordered by how
many documents hold them, the rarest alone is the necessary prefix. A document
meets a window only through that shingle; the shingle's place in the window bounds
where the window would start and end; the words there are then compared one by one.

Up to ``block_windows`` windows (a proven size) are sent to the executors with their prefixes, and documents are
compared where they lie. With more, prefix shingles are shuffled: documents send the places of
shingles that a filter of bounded size lets through, with the words around, and are joined with the windows
by the shingle. Both ways give the same rows. Corpus frequencies count every document; of equally rare shingles the one with the least hash is taken.

Null or wordless texts have no words and no hits. Items without an id or without
words are ignored. Rows that share an item_id count as one item. Repeated document
rows each get their own result. An empty table of documents gives no rows, one of items no hits. Very long texts are read whole. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as ex
from quern.llm import textpack as tp
from quern.llm.store import materialise, measured

SHINGLE = 3
COLUMNS = "doc_id bigint, text_hash bigint, n_words bigint, hit_spans array<int>, item_ids array<string>"


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                w = tp.split(part["text"], tp.ALNUM_WORDS, lower=True)
                ids = part["item_id"].to_pylist()
                h = w.hash.view(np.int64)
                out_id, out_h = [], []
                for d in np.flatnonzero(w.counts):
                    a, b = w.first[d], w.first[d + 1]
                    n = min(width, b - a)
                    for s in range(a, b - n + 1):
                        out_id.append(ids[d])
                        out_h.append(h[s : s + n].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_h, pa.list_(pa.int64()))], ["item_id", "words"])

    return run


def _shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Width and hashes of the shingles of a window given as word hashes."""
    n = min(SHINGLE, len(words))
    x = np.full(len(words) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            x = x * tp._BASE + words[k : len(words) - n + 1 + k]
        return n, tp.mix(x)


def _frequencies(tokens: dict[int, np.ndarray]):
    """Counts the documents that hold each of the given shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: np.zeros(len(t), np.int64) for n, t in tokens.items()}
        for batch in batches:
            for part in tp.slices(batch, "text"):
                w = tp.split(part["text"], tp.ALNUM_WORDS, lower=True)
                for n, t in tokens.items():
                    at, h = w.windows(n)
                    i = np.minimum(np.searchsorted(t, h), len(t) - 1)
                    ok = t[i] == h
                    pair = np.unique(w.doc[at[ok]] * len(t) + i[ok])
                    counts[n] += np.bincount(pair % len(t), minlength=len(t))
        for n, t in tokens.items():
            some = np.flatnonzero(counts[n])
            yield pa.RecordBatch.from_arrays([pa.array(t[some].view(np.int64)), pa.array(counts[n][some])], ["token", "n_docs"])

    return run


def _scan(index: dict):
    """Finds the windows of one block in every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                yield find(part, index)

    return run


def find(part: pa.RecordBatch, index: dict) -> pa.RecordBatch:
    w = tp.split(part["text"], tp.ALNUM_WORDS, lower=True)
    h, last = w.hash, w.first[1:]
    starts, wins = [], []
    for n, (tokens, offsets, window) in index["prefix"].items():
        at, sh = w.windows(n)
        lo = np.searchsorted(tokens, sh, side="left")
        hit = np.flatnonzero((lo < len(tokens)) & (tokens[np.minimum(lo, len(tokens) - 1)] == sh))
        many = np.searchsorted(tokens, sh[hit], side="right") - lo[hit]
        which = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        word = np.repeat(at[hit], many)
        win, begin = window[which], word - offsets[which]
        size, doc = index["size"][win], w.doc[word]
        ok = (begin >= w.first[doc]) & (begin + size <= last[doc])  # positional and length bounds
        win, begin, size = win[ok], begin[ok], size[ok]
        for k in range(index["words"].shape[1]):
            if not len(win):
                break
            ok = (k >= size) | (h[np.minimum(begin + k, len(h) - 1)] == index["words"][win, k])
            win, begin, size = win[ok], begin[ok], size[ok]
        starts.append(begin)
        wins.append(win)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    win = np.concatenate(wins) if wins else np.zeros(0, np.int64)
    cover = tp.covered(len(h), begin, index["size"][win])
    edge = np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))
    # A span ends where its text ends, even if the next text begins with a hit.
    inner = w.first[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < len(h))])
    cut = cut[cover[cut - 1] & cover[cut]] if len(cut) else cut
    a = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    b = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    spans: list[list[int]] = [[] for _ in range(part.num_rows)]
    items: list[list[str]] = [[] for _ in range(part.num_rows)]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        d = int(w.doc[x])
        spans[d] += [x - int(w.first[d]), y - int(w.first[d])]
    names = len(index["names"])
    for x in np.unique(w.doc[begin] * names + index["item"][win]).tolist():
        items[x // names].append(index["names"][x % names])
    return pa.RecordBatch.from_arrays(
        [part["doc_id"], part["text_hash"], pa.array(w.counts), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
        ["doc_id", "text_hash", "n_words", "hit_spans", "item_ids"],
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, block_windows: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, hit_spans (begin and end word of each hit run, flattened) and item_ids (sorted strings)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = items.select(F.col("item_id").cast("string"), F.col("text")).where("item_id is not null and text is not null")
    windows, seen = measured(items.mapInArrow(tp.task(_item_windows(width)), "item_id string, words array<bigint>").distinct(), n=F.count(F.lit(1)))
    if seen["n"] > block_windows:
        return _shuffled(docs, windows, width)
    found = docs.mapInArrow(tp.task(_scan(_index(docs, windows.collect(), width))), COLUMNS)
    return found.select("doc_id", "n_words", "hit_spans", F.array_sort("item_ids").alias("item_ids"))


def _window_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every window, with its place."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            n, h = _shingles(np.array(r["words"], np.int64).view(np.uint64))
            rows += [(r["item_id"], r["words"], n, int(t), k) for k, t in enumerate(h.view(np.int64).tolist())]
        kinds = (pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["item_id", "words", "width", "token", "place"])


def _marked(found, sh: np.ndarray) -> np.ndarray:
    return np.arange(len(sh)) if found is None else np.flatnonzero(found.value.marked(sh.view(np.int64)))


def _seen(widths: list[int], found):
    """How many documents of a slice hold each shingle that may be one of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                w = tp.split(part["text"], tp.ALNUM_WORDS, lower=True)
                for n in widths:
                    at, h = w.windows(n)
                    some = _marked(found, h)
                    pair = np.unique(np.stack([h[some], w.doc[at[some]].astype(np.uint64)]), axis=1)
                    token, times = np.unique(pair[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], ["token", "docs"])

    return run


def _places(widths: list[int], found, width: int):
    """Places of shingles that may be prefixes, with the words that a window around them could hold, and where these begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                w = tp.split(part["text"], tp.ALNUM_WORDS, lower=True)
                words = w.hash.view(np.int64)
                for n in widths:
                    at, h = w.windows(n)
                    some = _marked(found, h)
                    at, token, doc = at[some], h[some].view(np.int64), w.doc[at[some]]
                    low, high = np.maximum(at - width + n, w.first[doc]), np.minimum(at + width, w.first[doc + 1])
                    size = high - low
                    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    flat = words[np.arange(cut[-1]) - np.repeat(cut[:-1] - low, size)] if len(at) else words[:0]
                    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([part["doc_id"].take(take), part["text_hash"].take(take), pa.array(token), pa.array(at - low), pa.array(low - w.first[doc]), lists], ["doc_id", "text_hash", "token", "inside", "begins", "around"])

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tp.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], pa.array(tp.split(part["text"], tp.ALNUM_WORDS, lower=True).counts)], ["doc_id", "text_hash", "n_words"])


def _shuffled(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """The same by a shuffle of prefix shingles."""
    tokens = materialise(windows.mapInArrow(tp.task(_window_tokens), "item_id string, words array<bigint>, width int, token bigint, place int"))
    widths = sorted(r["width"] for r in tokens.select("width").distinct().collect())  # SHINGLE of them at most
    often = docs.select("text").mapInArrow(tp.task(_seen(widths, ex.marks(tokens.select("token").distinct()))), "token bigint, docs bigint").groupBy("token").agg(F.sum("docs").alias("docs"))
    rank = F.struct(F.coalesce("docs", F.lit(0)), "token", "place")
    prefixes = materialise(tokens.join(often, "token", "left").groupBy("item_id", "words").agg(F.min_by(F.struct("token", "place"), rank).alias("p")).select("item_id", "words", "p.token", "p.place"))
    placed = docs.mapInArrow(tp.task(_places(widths, ex.marks(prefixes.select("token").distinct()), width)), "doc_id bigint, text_hash bigint, token bigint, inside bigint, begins bigint, around array<bigint>")
    at = (F.col("inside") - F.col("place")).cast("int")
    # Positional and length bounds come with the slice, which is shorter where a window would not fit.
    hit = placed.join(prefixes, "token").where((at >= 0) & (F.slice("around", F.greatest(at, F.lit(0)) + 1, F.size("words")) == F.col("words")))
    begin = F.col("begins") + at
    per_doc = hit.select("doc_id", "text_hash", "item_id", F.array(begin, begin + F.size("words")).cast("array<int>").alias("span")).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("span")).alias("flat"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    every = docs.mapInArrow(tp.task(_lengths), "doc_id bigint, text_hash bigint, n_words bigint")
    same = every["doc_id"].eqNullSafe(per_doc["doc_id"]) & (every["text_hash"] == per_doc["text_hash"])
    empty = F.array().cast("array<int>"), F.array().cast("array<string>")
    rows = every.join(per_doc, same, "left").select(every["doc_id"], "n_words", F.coalesce("flat", empty[0]).alias("flat"), F.coalesce("item_ids", empty[1]).alias("item_ids"))
    return rows.mapInArrow(tp.task(_joined), "doc_id bigint, n_words bigint, hit_spans array<int>, item_ids array<string>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order and without overlaps."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            spans: list[int] = []
            for a, b in sorted(zip(r["flat"][::2], r["flat"][1::2], strict=True)):
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                else:
                    spans += [a, b]
            rows.append((r["doc_id"], r["n_words"], spans, r["item_ids"]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_words", "hit_spans", "item_ids"])


def _index(docs: DataFrame, rows: list, width: int) -> dict:
    """The windows of a block, sorted by the rarest shingle of each."""
    names = sorted({r.item_id for r in rows})
    place = {x: i for i, x in enumerate(names)}
    words = np.zeros((len(rows), width), np.uint64)
    size = np.array([len(r.words) for r in rows], np.int64)
    own = []
    for i, r in enumerate(rows):
        words[i, : size[i]] = np.array(r.words, np.int64).view(np.uint64)
        own.append(_shingles(words[i, : size[i]]))
    tokens = {n: np.unique(np.concatenate([h for m, h in own if m == n])) for n in sorted({m for m, _ in own})}
    index: dict = {"words": words, "size": size, "names": names or [""], "item": np.array([place[r.item_id] for r in rows], np.int64), "prefix": {}}
    if not rows:
        return index
    counted = docs.select("text").mapInArrow(tp.task(_frequencies(tokens)), "token bigint, n_docs bigint").groupBy("token").agg(F.sum("n_docs").alias("n_docs")).collect()
    often = {r.token: r.n_docs for r in counted}
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for i, (n, h) in enumerate(own):
        rank = [(often.get(t, 0), t, k) for k, t in enumerate(h.view(np.int64).tolist())]
        _, token, k = min(rank)
        chosen.setdefault(n, []).append((token % 2**64, k, i))
    for n, x in chosen.items():
        x.sort()
        index["prefix"][n] = (np.array([y[0] for y in x], np.uint64), np.array([y[1] for y in x], np.int64), np.array([y[2] for y in x], np.int64))
    return index


def digest(found: DataFrame) -> DataFrame:
    spans = F.expr("aggregate(sequence(0, size(hit_spans) div 2), 0L, (s, i) -> s + coalesce(get(hit_spans, 2 * i + 1) - get(hit_spans, 2 * i), 0))")
    return found.select(
        "doc_id", "n_words", spans.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )
