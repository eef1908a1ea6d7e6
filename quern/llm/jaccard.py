"""Exact n-gram Jaccard join by signature trees: links between documents with similar shingle sets.

1. Every text becomes a set of shingle hashes. Texts with equal sets are one class.
2. Which classes can have a similar one at all? A set may miss one part in five of its tokens
   in a similar set, so of any subset of the tokens chosen by their hash, all but that many must
   be held by another class too. One token in two is counted that way over the corpus;
   classes with too many tokens of their own are done.
3. Tokens of the remaining classes are ordered by how many of these hold them. Similar classes
   share one of their rarest tokens (the prefix). Every class has a home: the token with the least
   hash among those about as frequent as its median one, which near copies mostly have in common.
   Classes meet in homes: if two that could be similar share a prefix token, the one with
   the later home visits the other's.
4. In each home a signature tree finds the similar pairs among its own classes, and between
   these and the visitors, by exact comparison of what its dual traversal cannot rule out.

So each pair of classes is compared in one place. A home too large for one task is dealt into
blocks, and every two blocks meet; K different texts that are near copies of each other so cost K * K
comparisons, spread over the tasks. Where only components are wanted (``links=False``), pairs that are
connected already are passed over, each block of a large home meets a few pivots, and only classes
that the pivots leave unconnected meet all blocks, so such a group costs as much as its size.

What is frequent does not gather in a task: a slice of the input sends a token once (twice in
step 2), however many of its classes hold it, and homes are sought by (token, home, size).
Classes that hold a thousandth of all rows or more (a thousand at most) are joined by broadcast.

Hashes have 64 bits (keys of classes 128), exact as far as they do not collide. Texts without words, and
null texts, have empty sets, link with nothing and are their own component (null doc_ids give a null
component and no links). Repeated rows are exact copies. Rows that share a doc_id are documents of
their own; each gets the smallest doc_id that its own links reach. Ties between tokens go by hash and change no
result. Very long texts are read whole; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as ex
from quern.llm import textpack as tp
from quern.llm.components import components
from quern.llm.signature import SignatureTree
from quern.llm.store import materialise, measured

#: Tokens below this hash are counted in step 2.
HALF = np.uint64(1 << 63)
#: Classes, and tokens, that a block holds.
BLOCK_SETS = 1024
BLOCK_TOKENS = 1 << 20
PIVOTS = 32
#: Tokens that a task of the exchanges holds, and those of a slice of sets.
GROUP = 1 << 20
SLICE = 1 << 18
#: Classes with at least this share of all rows are joined by broadcast, so there are 1 / HOT of them at most.
HOT = 1 / 1000


def shingles(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text in rising order, and where each text's begin."""
    w = tp.split(part["text"], lower=True)
    at, h = w.windows(width)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        own = []
        for d in short.tolist():
            x = np.array([len(w.hash[w.first[d] : w.first[d + 1]])], np.uint64)
            for k in range(w.first[d], w.first[d + 1]):
                x = x * tp._BASE + w.hash[k : k + 1]
            own.append(tp.mix(x))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, *own])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(part.num_rows + 1))


def _keys(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set, as two integers; the first is the number of its class."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tp.mix(h ^ np.uint64(salt)))])
        out.append(tp.mix(total[first[1:]] - total[first[:-1]] + (first[1:] - first[:-1]).astype(np.uint64)).view(np.int64))
    return out


def _sign(width: int):
    """doc_id, size and key of every set, and how many of its tokens are counted in step 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                h, first = shingles(part, width)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, (np.diff(first), tp.doc_sums(h < HALF, first), *_keys(h, first)))], ["doc_id", "n", "n_half", "hi", "lo"])

    return run


def _rows(gid: np.ndarray, *columns: tuple[np.ndarray, int]) -> list[tuple]:
    """One row for each run of equal groups: the group, and each column packed in so many bytes (0: as documents)."""
    at = ex.cuts(gid)
    return [(int(gid[a]), *(ex.planes(x[a:b], n) if n else ex.pack_docs(x[a:b]) for x, n in columns)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(len(names))], names)


def _all(rows: pd.Series, n: int) -> np.ndarray:
    """What packed values of ``n`` bytes (0: documents) hold, one after the other."""
    parts = [ex.unplanes(b, n) if n else ex.unpack_docs(b) for b in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64 if n else np.int64)


def _send_half(width: int, n_groups: int):
    """Rows of tokens and two classes at most that hold each; and, with group -1 - bucket, how many tokens of further classes are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch.filter(batch["doc_id"].is_valid()), "text"):
                h, first = shingles(part, width)
                low = h < HALF
                token, cls = h[low], np.repeat(_keys(h, first)[0], np.diff(first))[low]
                order = np.lexsort((cls, token))
                token, cls = token[order], cls[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
                token, cls = token[new], cls[new]
                at = ex.cuts(token)
                sent = np.arange(len(token)) - np.repeat(at[:-1], np.diff(at)) < 2
                known, times = np.unique(cls[~sent], return_counts=True)
                token, cls = token[sent], cls[sent]
                gid = ex.place(token, n_groups)
                order = np.lexsort((token, cls, gid))
                rows = _rows(gid[order], (cls[order], 0), (token[order], 5))
                bucket = ex.place(known, n_groups)
                order = np.argsort(bucket, kind="stable")
                yield _batch(rows + _rows(-1 - bucket[order], (known[order], 0), (times[order], 4)), ["gid", "classes", "tokens"])

    return run


def _count_shared(n_buckets: int):
    """How many tokens of each class others hold too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "classes", "counts"]
        if rows["gid"].iloc[0] < 0:  # what slices knew already
            return rows.set_axis(names, axis=1).assign(bucket=-1 - rows["gid"])
        cls, token = _all(rows["classes"], 0), _all(rows["tokens"], 5)
        order = np.lexsort((cls, token))
        cls, token = cls[order], token[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (token[1:] != token[:-1])
        cls, at = cls[new], ex.cuts(token[new])
        some, counts = np.unique(cls[np.repeat(np.diff(at) > 1, np.diff(at))], return_counts=True)
        bucket = ex.place(some, n_buckets)
        order = np.argsort(bucket, kind="stable")
        return pd.DataFrame(_rows(bucket[order], (some[order], 0), (counts[order], 4)), columns=names)

    return run


def _add_shared(rows: pd.DataFrame) -> pd.DataFrame:
    some, inverse = np.unique(_all(rows["classes"], 0), return_inverse=True)
    return pd.DataFrame({"hi": some, "shared": np.bincount(inverse, weights=_all(rows["counts"], 4).astype(np.int64)).astype(np.int64)})


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                h, first = shingles(part, width)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, _keys(h, first)), lists], ["doc_id", "hi", "lo", "tokens"])

    return run


_SLICE = ["slice", "classes", "sizes", "copies", "tokens"]


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets packed into slices of about SLICE tokens each, which have numbers of their own."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        size = batch["n"].to_numpy()
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            some = batch.slice(at, to - at)
            tokens = pa.concat_arrays([some["tokens"]]).flatten().to_numpy()
            yield _batch([(number, some["hi"].to_numpy().tobytes(), some["n"].to_numpy().tobytes(), some["copies"].to_numpy().tobytes(), tokens.tobytes())], _SLICE)
            number, at = number + 1, to


def _of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices one by one: number, classes, sizes, copies and tokens."""
    for batch in batches:
        for r in batch.to_pylist():
            yield (r["slice"], *(np.frombuffer(r[c], np.int64) for c in _SLICE[1:4]), np.frombuffer(r["tokens"], np.uint64))


def _send_all(n_groups: int):
    """Every token of a slice once, with the number of the slice's sets that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, _, tokens in _of_slices(batches):
            token, times = np.unique(tokens, return_counts=True)
            gid = ex.place(token, n_groups)
            order = np.argsort(gid, kind="stable")
            rows = [(*r, number) for r in _rows(gid[order], (token[order], 8), (times[order], 4))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64()))], ["gid", "tokens", "times", "slice"])

    return run


def _rank(rows: pd.DataFrame) -> pd.DataFrame:
    """For each slice its tokens that several sets hold, with the logarithm of how many."""
    token, times = _all(rows["tokens"], 8), _all(rows["times"], 4).astype(np.int64)
    number = np.repeat(rows["slice"].to_numpy(), [len(b) // 8 for b in rows["tokens"]])
    order = np.lexsort((number, token))
    token, times, number = token[order], times[order], number[order]
    at = ex.cuts(token)
    total = np.repeat(np.add.reduceat(times, at[:-1]), np.diff(at))
    keep = total > 1
    token, number, often = token[keep], number[keep], np.minimum(255, 8 * np.log2(total[keep])).astype(np.int64)
    order = np.lexsort((token, number))
    return pd.DataFrame(_rows(number[order], (token[order], 8), (often[order], 1)), columns=["slice", "tokens", "often"])


def _homes(n_groups: int):
    """For a slice: prefix tokens with the homes and sizes of their sets, by groups of tokens; and, with group -1, each set with its home and size."""
    names = ["gid", "classes", "tokens", "homes", "sizes"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        cls, size = (np.frombuffer(left[c].iloc[0], np.int64) for c in ("classes", "sizes"))
        token, own = np.frombuffer(left["tokens"].iloc[0], np.uint64), np.repeat(np.arange(len(size)), size)
        known, often = _all(right["tokens"], 8), _all(right["often"], 1).astype(np.int64)
        order = np.argsort(known)
        known, often = known[order], often[order]
        at = np.minimum(np.searchsorted(known, token), len(known) - 1)
        often = np.where(known[at] == token, often[at], 0)
        order = np.lexsort((token, often, own))
        token, often = token[order], often[order]
        first = np.cumsum(size) - size
        shared = np.add.reduceat((often > 0).astype(np.int64), first)
        # Tokens of no other set come first; the median of the others tells how frequent the home is.
        middle = often[first + np.minimum(size - shared + shared // 2, size - 1)] >> 3
        last = np.uint64(2**63 - 1)
        each = np.where((often > 0) & (often >> 3 == middle[own]), (np.uint64(127) - (often >> 3).astype(np.uint64) << np.uint64(56)) | (tp.mix(token ^ np.uint64(0xA4093822299F31D0)) >> np.uint64(8)), last)
        home = np.minimum.reduceat(each, first).view(np.int64)
        some = shared > 0
        prefix = (np.arange(len(token)) - first[own] < (size - (4 * size + 4) // 5 + 1)[own]) & (often > 0)
        # Sets with one home and size need one row.
        token, own = token[prefix], own[prefix]
        order = np.lexsort((size[own], home[own], token))
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (home[own[1:]] != home[own[:-1]]) | (size[own[1:]] != size[own[:-1]])
        token, own = token[new], own[new]
        gid = ex.place(token, n_groups)
        order = np.argsort(gid, kind="stable")
        own, token, gid = own[order], token[order], gid[order]
        rows = [(g, b"", t, h, n) for g, t, h, n in _rows(gid, (token, 8), (home[own], 8), (size[own], 4))]
        return pd.DataFrame([(-1, cls[some].tobytes(), b"", home[some].tobytes(), size[some].tobytes()), *rows], columns=names)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("classes", "homes", "sizes")], ["cls", "home", "n"])


def _visits(rows: pd.DataFrame) -> pd.DataFrame:
    """Which earlier homes the sets of a home and size visit, for prefix tokens that sets of other homes have too."""
    token, home, n = _all(rows["tokens"], 8), _all(rows["homes"], 8).view(np.int64), _all(rows["sizes"], 4).astype(np.int64)
    order = np.lexsort((n, home, token))
    token, home, n = token[order], home[order], n[order]
    at = ex.cuts(token)
    several = np.flatnonzero(home[at[:-1]] != home[at[1:] - 1])
    # Tokens whose rows are alike lead to the same visits.
    marks = np.add.reduceat(tp.mix(home.view(np.uint64) + n.astype(np.uint64) * tp._BASE), at[:-1])[several] if len(several) else np.zeros(0, np.uint64)
    several = several[np.unique(marks, return_index=True)[1]]
    found = []
    for a, b in zip(at[several].tolist(), at[several + 1].tolist(), strict=True):
        h, size = home[a:b], n[a:b]
        cuts = ex.cuts(h)
        for x, y in zip(cuts[:-2].tolist(), cuts[1:-1].tolist(), strict=True):
            theirs, mine = size[x:y], size[y:]  # sorted sizes of a home; all later homes
            fits = np.searchsorted(theirs, -(-4 * mine // 5), side="left") < np.searchsorted(theirs, 5 * mine // 4, side="right")
            found.append(np.stack([h[y:][fits], mine[fits], np.full(int(fits.sum()), h[x])]))
        if sum(x.shape[1] for x in found) > GROUP:
            found = [np.unique(np.concatenate(found, axis=1), axis=1)]
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    return pd.DataFrame({"home": pairs[0], "n": pairs[1], "visit": pairs[2]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, cls, size, copies, tokens in _of_slices(batches):
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(copies), pa.ListArray.from_arrays(pa.array(first), pa.array(tokens.view(np.int64)))], ["cls", "copies", "tokens"])


def _grouped(batches: Iterator[pa.RecordBatch], solve) -> Iterator[pa.RecordBatch]:
    """``solve`` of each run of rows of the same group: its table, and the sets of its rows."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        lists = pa.concat_arrays(table["tokens"].chunks)
        token, first = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        return solve(table, [token[first[i] : first[i + 1]] for i in range(len(table))])

    now = None
    for batch in batches:
        gid = np.stack([batch["home"].to_numpy(), batch["block"].to_numpy()], axis=1)
        change = np.flatnonzero((gid[1:] != gid[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if held and (gid[a] != now).any():
                yield flush()
            now = gid[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set with one that stands for its component in the group, and whether it is connected there with the first pivot."""

    def solve(table: pa.Table, sets: list[np.ndarray]) -> pa.RecordBatch:
        cls, pivot = table["cls"].to_numpy(), np.flatnonzero(table["pivot"].to_numpy())
        root = SignatureTree(sets).traverse()
        main = root == root[pivot[np.argmin(cls[pivot])]] if len(pivot) else np.zeros(len(root), bool)
        return pa.RecordBatch.from_arrays([table["home"].combine_chunks(), pa.array(cls), pa.array(cls[root]), pa.array(main)], ["home", "a", "b", "main"])

    yield from _grouped(batches, solve)


def _count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All similar pairs of groups, or of those with two blocks all across: a set with one that stands for its component and the copies of its partners."""

    def solve(table: pa.Table, sets: list[np.ndarray]) -> pa.RecordBatch:
        cls, own, side = table["cls"].to_numpy(), table["own"].to_numpy(), table["side"].to_numpy()
        # Visitors meet each other in a home of one of them.
        across = side.min() != side.max()
        links, root = SignatureTree(sets).partners(table["copies"].to_numpy(), lambda x, y: (own[x] | own[y]) & ((side[x] != side[y]) | (not across)))
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(cls[root]), pa.array(links)], ["a", "b", "links"])

    yield from _grouped(batches, solve)


def _dealt(members: DataFrame, *columns: str) -> DataFrame:
    """Members by home and block, those of a group one after the other."""
    return members.select("home", "block", "cls", *columns, "tokens").repartition("home", "block").sortWithinPartitions("home", "block")


def meet(slices: DataFrame, total: int, group: int) -> DataFrame:
    """(cls, home, n, own) for every set and every home where it may have a partner."""
    n_groups = max(8, total // group)
    ranked = slices.mapInArrow(tp.task(_send_all(n_groups)), "gid bigint, tokens binary, times binary, slice bigint").groupBy("gid").applyInPandas(_rank, "slice bigint, tokens binary, often binary")
    found = materialise(slices.groupBy("slice").cogroup(ranked.groupBy("slice")).applyInPandas(_homes(n_groups), "gid bigint, classes binary, tokens binary, homes binary, sizes binary"))
    placed = found.where("gid < 0").mapInArrow(tp.task(_placed), "cls bigint, home bigint, n bigint")
    visits = found.where("gid >= 0").groupBy("gid").applyInPandas(_visits, "home bigint, n bigint, visit bigint").distinct()
    guests = placed.join(visits, ["home", "n"]).select("cls", F.col("visit").alias("home"), "n", F.lit(False).alias("own")).distinct()
    return materialise(placed.withColumn("own", F.lit(True)).unionByName(guests))


def link(docs: DataFrame, classes: DataFrame, n_half: int, width: int, block_sets: int, block_tokens: int, group: int, links: bool) -> DataFrame:
    """(hi, lo, least_doc), with ``links`` also the rows of other classes that it is linked with, for every class that is linked with another."""
    n_groups = max(8, n_half // group)
    sent = docs.mapInArrow(tp.task(_send_half(width, n_groups)), "gid bigint, classes binary, tokens binary")
    shared = sent.groupBy("gid").applyInPandas(_count_shared(n_groups), "bucket bigint, classes binary, counts binary").groupBy("bucket").applyInPandas(_add_shared, "hi bigint, shared bigint")
    may = materialise(classes.join(shared, "hi", "left").where("coalesce(shared, 0) >= n_half - (n - (4 * n + 4) div 5)").select("hi", "lo", "rep", "n", "copies"))
    # One set for each class, from the text of its smallest document.
    texts = ex.parted(docs, may.select("rep"))(True, _sets(width), schema="doc_id bigint, hi bigint, lo bigint, tokens array<bigint>")
    sets = texts.join(may, ["hi", "lo"]).where("doc_id = rep").dropDuplicates(["hi", "lo"])
    slices, seen = measured(sets.select("hi", "n", "copies", "tokens").mapInArrow(tp.task(_slice), "slice bigint, classes binary, sizes binary, copies binary, tokens binary"), n=F.sum(F.octet_length("tokens") / 8))

    met = meet(slices, int(seen["n"] or 0), group)
    blocks = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_tokens)).cast("int")
    sized = met.groupBy("home").agg(F.count("*").alias("size"), F.max("own").alias("owned"), blocks.alias("blocks")).where("size > 1 and owned").drop("owned")
    sets = slices.mapInArrow(tp.task(_unpacked), "cls bigint, copies bigint, tokens array<bigint>")
    members = met.join(sized, "home").join(sets, "cls").withColumn("side", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if links:
        # A block by itself knows its pairs; with another one, those across are left.
        both = members.withColumn("other", every).withColumn("block", F.least("side", "other").cast("bigint") * F.col("blocks") + F.greatest("side", "other"))
        pairs = materialise(_dealt(both, "copies", "own", "side").mapInArrow(tp.task(_count_links), "a bigint, b bigint, links bigint"))
        labels = components(pairs)
        counts = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        return _named(labels, may).join(counts, "node").select("hi", "lo", "least_doc", "links")

    draw = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    pivot = (F.col("blocks") > 1) & (draw < F.lit(float(PIVOTS)) / F.col("size"))
    at = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("side")))
    found = "home bigint, a bigint, b bigint, main boolean"
    edges = materialise(_dealt(members.withColumn("pivot", pivot).withColumn("block", at), "pivot").mapInArrow(tp.task(_connect), found))
    # Sets of large homes that the pivots left unconnected, in blocks of their own, meet every block of their home.
    main = edges.where("main").select("home", F.col("a").alias("cls")).distinct()
    large = met.join(sized.where("blocks > 1"), "home")
    rest, seen = measured(large.join(main, ["home", "cls"], "left_anti").select("home", "cls"), n=F.count(F.lit(1)))
    if seen["n"]:
        rests = rest.groupBy("home").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("rests"))
        row = F.pmod(F.xxhash64("cls", F.lit("rest")), F.col("rests")).cast("bigint")
        ours = members.join(rests, "home").join(rest, ["home", "cls"], "left_semi").withColumn("other", every).withColumn("block", row * F.col("blocks") + F.col("other"))
        theirs = members.join(rests, "home").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("block", F.col("row").cast("bigint") * F.col("blocks") + F.col("side"))
        both = ours.select("home", "block", "cls", "tokens").unionByName(theirs.select("home", "block", "cls", "tokens")).withColumn("pivot", F.lit(False))
        edges = edges.unionByName(_dealt(both, "pivot").mapInArrow(tp.task(_connect), found))
    return _named(components(edges), may).select("hi", "lo", "least_doc")


def _named(labels: DataFrame, may: DataFrame) -> DataFrame:
    """Classes of the labels, with the smallest document of each label."""
    named = materialise(labels.join(may.select(F.col("hi").alias("node"), "hi", "lo", "rep"), "node"))
    return named.join(named.groupBy("label").agg(F.min("rep").alias("least_doc")), "label")


def join(docs: DataFrame, width: int = 5, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, for links of Jaccard similarity 0.8 or more.

    With ``links`` all pairs of similar classes are found, and n_links is the number of other rows that a row is linked with (null without a doc_id).
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(docs.mapInArrow(tp.task(_sign(width)), "doc_id bigint, n bigint, n_half bigint, hi bigint, lo bigint"))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("n_half").alias("n_half"), F.count("*").alias("copies"))
    classes, seen = measured(classes, half=F.sum("n_half"), rows=F.sum("copies"))
    linked = link(docs, classes, int(seen["half"] or 0), width, block_sets, block_tokens, group, links)

    count = [(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")] if links else []
    final = materialise(classes.join(linked, ["hi", "lo"], "left").select("hi", "lo", "copies", F.coalesce("least_doc", "rep").alias("component_id"), *count))
    each = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if links else []
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *each]
    hot = F.col("copies") >= F.lit(max(2.0, HOT * (seen["rows"] or 0)))
    few = F.broadcast(final.where(hot))
    cold = signed.join(few.select("hi", "lo"), ["hi", "lo"], "left_anti").join(final.where(~hot), ["hi", "lo"], "left")
    return signed.join(few, ["hi", "lo"]).select(*columns).unionAll(cold.select(*columns))
