"""Removal of word sequences that documents with smaller ids already hold.

1. Which windows of ``width`` words can recur at all? The suffixes of all texts, word by word, are split by prefixes of
   different lengths: a suffix goes to the group of its shortest prefix that few enough suffixes share, as counted
   over the whole corpus, so that each group fits in the memory of a task. There it is
   represented by a label of its first ``width`` words, a hash. A window whose label one document alone holds is done; this never
   loses a sequence that recurs, and lets others through as often as labels collide.
2. What is left is compared word by word. Neighbouring windows that agree on their rarest-hashed run of ``ANCHOR`` words are a
   region, which is sent with its words to the group of that run, so that equal windows meet. A group sorts all
   suffixes of its regions by their words, by doubling (ranks of 1, 2, 4, 8 words and so of ``width``, each from two ranks
   before, exact and without hashes). Runs of equal ranks are suffixes whose common prefix has ``width`` words or more:
   the deep internal nodes of the group's suffix tree. The smallest document of a node keeps the sequence; the
   windows of the others are lost, and runs of lost windows are the maximal repeats of a document. Their words go.

So hashes decide where things are compared, and not what is equal. What is shuffled in step 1 for a suffix is its label
and its document, and a slice of the input sends a label once only, for its smallest document; in step 2 it sends equal regions
once. So a passage in a third of all texts costs a record for each slice. Texts without a window that may recur are never
shuffled while a filter of bounded size can tell which these are.

Null and wordless texts have no words. Texts of fewer than ``width`` words lose nothing.
A sequence that recurs in one document only, stays. Rows that share a doc_id count as one
document, and equal rows lose the same. Rows without a doc_id lose nothing and take nothing from others. An empty table gives no rows. Extra columns are
ignored, whatever their names; very long texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import blobs
from quern.llm import exchange as ex
from quern.llm import textpack as tp
from quern.llm.store import materialise, measured

#: Lengths of prefix, in words, that are counted; the last is the width itself.
LENGTHS = (1, 2, 4, 8)
COUNTERS = 4096
#: Suffixes that a group holds, on the average of light prefixes.
GROUP = 1 << 18
#: Bits of a label. A group holds about 2^18 labels at any size of the corpus, so one window in 2^14 is compared for nothing.
LABEL_BITS = 32
#: Words of the run that neighbouring windows have in common.
ANCHOR = 4
#: Bytes of text whose suffixes are sorted together before they are sent.
SLICE = 2 << 20


def paths(w: tp.Words, width: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Every suffix of at least ``width`` words: its first word, and hashes of its prefixes."""
    n = len(w.start) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), {k: np.zeros(0, np.uint64) for k in (*LENGTHS, width)}
    at = np.flatnonzero(w.doc[:n] == w.doc[width - 1 :])
    h, x, out = w.hash, np.full(len(at), np.uint64(width)), {}
    for k in range(width):
        x = x * tp._BASE + h[at + k]
        if k + 1 in LENGTHS or k + 1 == width:
            out[k + 1] = tp.mix(x)
    return at, out


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LENGTHS), COUNTERS), np.int64)
        for batch in batches:
            for part in tp.slices(batch, "text", SLICE):
                counts += _counted(part, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(LENGTHS)), pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary())], ["block", "sums"])

    return run


def _counted(part: pa.RecordBatch, width: int) -> np.ndarray:
    _, path = paths(tp.split(part["text"]), width)
    return np.array([np.bincount((path[k] >> np.uint64(52)).astype(np.int64), minlength=COUNTERS) for k in LENGTHS])


def plan(docs: DataFrame, width: int, group: int = GROUP, bits: int = LABEL_BITS) -> dict:
    """Which prefixes are light enough to be a group, and how many bits split the rest of the way."""
    counts = blobs.add(docs.select("text").mapInArrow(tp.task(_count(width)), blobs.SCHEMA), "int64")
    table = np.array([counts.get(i, np.zeros(COUNTERS, np.int64)) for i in range(len(LENGTHS))])
    total = int(table[0].sum())
    buckets = int(min(COUNTERS, max(16, 1 << int(np.ceil(np.log2(max(1, total / group)))))))
    folded = table.reshape(len(LENGTHS), buckets, -1).sum(axis=2)
    more = max(0, int(np.ceil(np.log2(max(1, total / buckets / group)))))
    return {"width": width, "shift": np.uint64(64 - int(np.log2(buckets))), "light": folded <= 2 * max(1, total // buckets), "more": np.uint64(more), "total": total, "label": np.uint64((1 << bits) - 1)}


def groups(path: dict[int, np.ndarray], how: dict) -> tuple[np.ndarray, np.ndarray]:
    """Group and label of every suffix."""
    whole = path[how["width"]]
    gid = (np.int64(len(LENGTHS)) << np.int64(32)) | (whole >> how["shift"]).astype(np.int64)
    for i in range(len(LENGTHS) - 1, -1, -1):
        bucket = (path[LENGTHS[i]] >> how["shift"]).astype(np.int64)
        gid = np.where(how["light"][i][bucket], (np.int64(i) << np.int64(32)) | bucket, gid)
    label = tp.mix(whole ^ np.uint64(0x5851F42D4C957F2D))
    if how["more"]:
        gid = (gid << np.int64(20)) | (label >> (np.uint64(64) - how["more"])).astype(np.int64)
    return gid, label & how["label"]


def _send(how: dict, n_buckets: int):
    """Rows (group, docs, labels); and, with group -1 - bucket, what a slice already knows to be in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch.filter(batch["doc_id"].is_valid()), "text", SLICE):
                yield _packed(part, how, n_buckets)

    return run


def _packed(part: pa.RecordBatch, how: dict, n_buckets: int) -> pa.RecordBatch:
    rows: tuple[list, list, list] = ([], [], [])
    gid, label, doc = _suffixes(part, how)
    if len(gid):
        node = np.ones(len(gid), bool)
        node[1:] = (gid[1:] != gid[:-1]) | (label[1:] != label[:-1])
        first = np.flatnonzero(node)
        last = np.append(first[1:], len(doc)) - 1
        known = (doc[first] != doc[last])[np.cumsum(node) - 1]
        for bucket, docs, labels in _by_bucket(doc[known], label[known], n_buckets):
            rows[0].append(-1 - bucket)
            rows[1].append(docs)
            rows[2].append(labels)
        # In the order of documents, so that their numbers compress.
        order = first[np.lexsort((doc[first], gid[first]))]
        gid, label, doc = gid[order], label[order], doc[order]
        at = ex.cuts(gid)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows[0].append(int(gid[a]))
            rows[1].append(ex.pack_docs(doc[a:b]))
            rows[2].append(ex.planes(label[a:b], 4))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["gid", "docs", "labels"])


def _suffixes(part: pa.RecordBatch, how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, label and document of every suffix of a slice, sorted by all three."""
    w = tp.split(part["text"])
    at, path = paths(w, how["width"])
    gid, label = groups(path, how)
    doc = part["doc_id"].to_numpy()[w.doc[at]]
    order = np.lexsort((doc, label, gid))
    return gid[order], label[order], doc[order]


def _by_bucket(doc: np.ndarray, label: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Labels that may recur, by buckets of documents."""
    if not len(doc):
        return
    bucket = ex.place(doc, n_buckets)
    order = np.lexsort((label, doc, bucket))
    bucket, doc, label = bucket[order], doc[order], label[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
    bucket, doc, label = bucket[new], doc[new], label[new]
    cuts = ex.cuts(bucket)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[a]), ex.pack_docs(doc[a:b]), ex.planes(label[a:b], 4)


def _several(n_buckets: int):
    """Labels of a group that several documents hold, for all of these."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["gid"].iloc[0] < 0:  # what slices knew already
            return pd.DataFrame({"bucket": -1 - rows["gid"], "docs": rows["docs"], "labels": rows["labels"]})
        doc = np.concatenate([ex.unpack_docs(b) for b in rows["docs"]])
        label = np.concatenate([ex.unplanes(b, 4) for b in rows["labels"]])
        order = np.lexsort((doc, label))
        doc, label = doc[order], label[order]
        cuts = ex.cuts(label)
        several = np.repeat(doc[cuts[:-1]] != doc[cuts[1:] - 1], np.diff(cuts))
        return pd.DataFrame(list(_by_bucket(doc[several], label[several], n_buckets)), columns=["bucket", "docs", "labels"])

    return run


def _by_doc(rows: pd.DataFrame) -> pd.DataFrame:
    doc = np.concatenate([ex.unpack_docs(b) for b in rows["docs"]])
    label = np.concatenate([ex.unplanes(b, 4) for b in rows["labels"]])
    order = np.lexsort((label, doc))
    doc, label = doc[order], label[order]
    cuts = ex.cuts(doc)
    return pd.DataFrame({"doc_id": doc[cuts[:-1]], "may": [ex.planes(np.unique(label[a:b]), 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def recurring(docs: DataFrame, how: dict) -> DataFrame:
    """(doc_id, may): labels of the windows that may recur, for every document that has some."""
    n_buckets = max(16, how["total"] // (1 << 20))
    sent = docs.select("doc_id", "text").mapInArrow(tp.task(_send(how, n_buckets)), "gid bigint, docs binary, labels binary")
    found = sent.groupBy("gid").applyInPandas(tp.group(_several(n_buckets)), "bucket bigint, docs binary, labels binary")
    return found.groupBy("bucket").applyInPandas(tp.group(_by_doc), "doc_id bigint, may binary")


_RANGES = "bucket bigint, docs binary, rows binary, starts binary, counts binary"
_REGIONS = "gid bigint, docs binary, rows binary, starts binary, counts binary, words binary"


def _ranges(key: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """Windows of rows, as first ones and numbers, packed by equal keys."""
    order = np.lexsort((start, row, doc, key))
    key, doc, row, start, count = key[order], doc[order], row[order], start[order], count[order]
    cuts = ex.cuts(key)
    return [(int(key[a]), ex.pack_docs(doc[a:b]), ex.planes(row[a:b], 8), ex.planes(start[a:b], 4), ex.planes(count[a:b], 4)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def regions(part: pa.RecordBatch, how: dict) -> tuple[tp.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that may recur: runs of neighbours with one anchor, as first window, number, and hash of the anchor."""
    width = how["width"]
    w = tp.split(part["text"])
    at, path = paths(w, width)
    _, label = groups(path, how)
    first = np.searchsorted(at, w.first)
    hit = np.zeros(len(at), bool)
    for d, b in enumerate(part["may"].to_pylist()):
        if b:
            hit[first[d] : first[d + 1]] = np.isin(label[first[d] : first[d + 1]], ex.unplanes(b, 4))
    begin = at[hit]
    if not len(begin):
        return w, begin, begin, np.zeros(0, np.uint64)
    short, h = w.windows(min(ANCHOR, width))
    gram = np.zeros(len(w.start), np.uint64)
    gram[short] = h
    span = width - min(ANCHOR, width) + 1
    best, place = gram[begin], begin
    for k in range(1, span):
        less = gram[begin + k] < best
        best, place = np.where(less, gram[begin + k], best), np.where(less, begin + k, place)
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1] + 1) | (place[1:] != place[:-1]) | (w.doc[begin[1:]] != w.doc[begin[:-1]])
    cut = np.flatnonzero(new)
    return w, begin[cut], np.diff(np.append(cut, len(begin))), best[cut]


def _send_regions(how: dict, n_groups: int, n_buckets: int):
    """Regions by groups of their anchors, equal ones for the smallest document only; and, with group -1 - bucket, what others so lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text", SLICE):
                rows = _sent(part, how, n_groups, n_buckets)
                kinds = (pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["gid", "docs", "rows", "starts", "counts", "words"])

    return run


def _sent(part: pa.RecordBatch, how: dict, n_groups: int, n_buckets: int) -> list[tuple]:
    w, begin, count, anchor = regions(part, how)
    if not len(begin):
        return []
    own = w.doc[begin]
    doc, row, start = part["doc_id"].to_numpy()[own], part["row"].to_numpy()[own], begin - w.first[own]
    raw = w.buf.tobytes()
    text = [raw[a:b] for a, b in zip(w.start[begin].tolist(), w.end[begin + count + how["width"] - 2].tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for t, d in zip(text, doc.tolist(), strict=True):
        if d < least.get(t, d + 1):
            least[t] = d
    lost = doc > np.array([least[t] for t in text], np.int64)
    rows = [(*r, b"") for r in _ranges(-1 - ex.place(row[lost], n_buckets), doc[lost], row[lost], start[lost], count[lost])]
    keep = np.flatnonzero(~lost)
    gid = ex.place(anchor[keep], n_groups)
    order = keep[np.lexsort((start[keep], row[keep], doc[keep], gid))]
    gid = np.sort(gid)
    cuts = ex.cuts(gid)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i = order[a:b]
        rows.append((int(gid[a]), ex.pack_docs(doc[i]), ex.planes(row[i], 8), ex.planes(start[i], 4), ex.planes(count[i], 4), b" ".join([text[k] for k in i.tolist()])))
    return rows


def suffix_ranks(words: np.ndarray, width: int) -> np.ndarray:
    """For each place the rank of its next ``width`` words among all places, in the order of words; the last places have ranks of what is left.

    Ranks of twice as many words come from two ranks, so equal ranks mean equal words.
    """
    rank, have, out, done = words.astype(np.int64), 1, None, 0

    def joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        behind = np.full(len(a), -1, np.int64)
        behind[: max(0, len(b) - gap)] = b[gap:]
        return np.unique(a * (len(a) + 2) + behind + 1, return_inverse=True)[1].astype(np.int64)

    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while have <= width:
        if width & have:
            out, done = (rank, have) if out is None else (joined(out, rank, done), done + have)
        if 2 * have <= width:
            rank = joined(rank, rank, have)
        have *= 2
    return out


def _sorted(width: int, n_buckets: int):
    """Suffixes of a group's regions in the order of their words; below each deep node all but the smallest document lose."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "docs", "rows", "starts", "counts"]
        if rows["gid"].iloc[0] < 0:  # what slices knew already
            return pd.DataFrame({"bucket": -1 - rows["gid"], **{n: rows[n] for n in names[1:]}})
        doc = np.concatenate([ex.unpack_docs(b) for b in rows["docs"]])
        row, start, count = (np.concatenate([ex.unplanes(b, n) for b in rows[c]]).view(np.int64) for c, n in (("rows", 8), ("starts", 4), ("counts", 4)))
        words = np.array([x for b in rows["words"] for x in b.split()], dtype=object)
        rank = suffix_ranks(pd.factorize(words)[0], width)
        size = count + width - 1
        first = np.cumsum(size) - size
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)  # places of windows
        owner = np.repeat(np.arange(len(doc)), count)
        node = rank[at]
        order = np.lexsort((doc[owner], node))
        cuts = ex.cuts(node[order])
        least = np.repeat(doc[owner[order[cuts[:-1]]]], np.diff(cuts))
        lost = np.sort(order[doc[owner[order]] > least])
        if not len(lost):
            return pd.DataFrame(columns=names)
        own = owner[lost]
        begin = start[own] + at[lost] - first[own]
        new = np.ones(len(lost), bool)
        new[1:] = (own[1:] != own[:-1]) | (begin[1:] != begin[:-1] + 1)
        cut = np.flatnonzero(new)
        own, begin, n = own[cut], begin[cut], np.diff(np.append(cut, len(lost)))
        return pd.DataFrame(_ranges(ex.place(row[own], n_buckets), doc[own], row[own], begin, n), columns=names)

    return run


def _by_row(rows: pd.DataFrame) -> pd.DataFrame:
    """The lost windows of each row of the table."""
    doc = np.concatenate([ex.unpack_docs(b) for b in rows["docs"]])
    row, start, count = (np.concatenate([ex.unplanes(b, n) for b in rows[c]]).view(np.int64) for c, n in (("rows", 8), ("starts", 4), ("counts", 4)))
    start = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    doc, row = np.repeat(doc, count), np.repeat(row, count)
    order = np.lexsort((start, row))
    doc, row, start = doc[order], row[order], start[order]
    cuts = ex.cuts(row)
    return pd.DataFrame({"doc_id": doc[cuts[:-1]], "row": row[cuts[:-1]], "lost": [ex.planes(np.unique(start[a:b]), 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def losses(docs: DataFrame, width: int = 13, group: int = GROUP, bits: int = LABEL_BITS) -> DataFrame:
    """(doc_id, row, lost): places of the windows whose words go, for every row of ``docs`` (doc_id, text, row) that loses some."""
    how = plan(docs, width, group, bits)
    may, seen = measured(recurring(docs, how), n=F.sum(F.octet_length("may") / 4))
    n = int(seen["n"] or 0)
    n_groups, n_buckets = max(16, n // group), max(16, n // (1 << 20))
    held = ex.parted(docs, may)(True).join(may, "doc_id")
    sent = held.select("doc_id", "text", "row", "may").mapInArrow(tp.task(_send_regions(how, n_groups, n_buckets)), _REGIONS)
    found = sent.groupBy("gid").applyInPandas(tp.group(_sorted(width, n_buckets)), _RANGES)
    return found.groupBy("bucket").applyInPandas(tp.group(_by_row), "doc_id bigint, row bigint, lost binary")


def cut(part: pa.RecordBatch, lost: list[bytes | None], width: int) -> tuple[tp.Words, np.ndarray]:
    """The words of each text, and which of them go."""
    w = tp.split(part["text"])
    begin = [np.zeros(0, np.int64)]
    for d, b in enumerate(lost):
        if b:
            begin.append(w.first[d] + ex.unplanes(b, 4).view(np.int64))
    begin = np.concatenate(begin)
    return w, tp.covered(len(w.start), begin, np.full(len(begin), width))


def _results(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text", SLICE):
                yield _kept(part, width, texts)

    return run


def _kept(part: pa.RecordBatch, width: int, texts: bool) -> pa.RecordBatch:
    w, gone = cut(part, part["lost"].to_pylist(), width)
    removed = tp.doc_sums(gone, w.first)
    raw, kept, spans = w.buf.tobytes(), [], []
    for d in range(part.num_rows):
        a, b = int(w.first[d]), int(w.first[d + 1])
        own = raw[int(w.off[d]) : int(w.off[d + 1])].split(None)
        keep = [x for x, g in zip(own, gone[a:b].tolist(), strict=True) if not g] if removed[d] else own
        kept.append(b" ".join(keep))
        spans.append(np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist() if texts else [])
    cols = [part["doc_id"], pa.array(w.counts), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if texts:
        cols += [pa.array([x.decode() for x in kept], pa.string()), pa.array(spans, pa.list_(pa.int32()))]
        names += ["kept_text", "removed_spans"]
    return pa.RecordBatch.from_arrays(cols, names)


def remove(docs: DataFrame, width: int = 13, texts: bool = True, group: int = GROUP, bits: int = LABEL_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the digest of what is kept; with ``texts`` kept_text and removed_spans (begin and end of each run of words, flattened)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string, removed_spans array<int>" * texts
    lost = materialise(losses(docs, width, group, bits))
    rows = ex.parted(docs.withColumn("lost", F.lit(None).cast("binary")), lost)
    whole = rows(False, _results(width, texts), schema=schema)
    losing = rows(True).drop("lost").join(lost.drop("doc_id"), "row", "left").select("doc_id", "text", "lost")
    return whole.unionByName(losing.mapInArrow(tp.task(_results(width, texts)), schema))
