"""Packing of token sequences by a linear program over configurations.

Texts become ids, ids become pieces of at most ``width`` tokens, and pieces are packed into sequences of at most
``width`` tokens. What the corpus says about packing is the histogram of lengths below ``width``, at most ``width`` - 1
numbers, whatever the size of the corpus. A configuration says how many pieces of each length share a sequence; the linear program asks
for the least number of sequences whose configurations hold all pieces. Multiplicative weights solve it: prices of
lengths fall as these are covered, and a knapsack by dynamic programming finds the configurations of the highest price. The
solution is rounded down, the rest is solved again, and the last few pieces are filled in one sequence at a time.

The plan, a bounded list of (configuration, number of sequences), goes to the executors. Each piece finds its place
from its rank among the pieces of its length, so no task ever holds the pieces of a sequence or of a length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textpack as tp
from quern.llm.store import materialise

#: Chunks of text whose ids a worker remembers, and their tokens; beyond either it starts anew.
MOST_CHUNKS, MOST_TOKENS = 1_000_000, 8_000_000
#: Bytes of new chunks that are encoded in a row.
ROW_BYTES = 1 << 16
#: White space other than spaces and line ends, and the character that marks cuts; and what stands together in texts that are cut otherwise.
_ODD, _DOUBLE = re.compile(r"[^\S \n]|\x00"), ("  ", " \n", "\n ", "\n\n")
#: Characters beyond the Latin letters.
_FAR = re.compile("[^\x00-ɏ]")
#: A space before what is certainly no white space: the vocabulary's words never reach over its front.
_FRONT = re.compile("(?= [!-~À-ɏ])")
#: Of the solver: rounds of a solution, how fast prices fall, the most that a round covers of a length, and how near to the highest price a configuration must be.
ROUNDS, FALL, STEP, NEAR = 60, 2.0, 0.04, 0.02
#: What breaks ties between prices, the share of a sequence that a configuration may waste at first, and what a piece more counts against a configuration.
JITTER, WASTE, FEW = 1e-5, 2e-3, 1e-2
#: Sequences with room to spare are taken only where what would fit into the room is less than this share of them.
SMALL = 1e-4
#: How often what rounding left is solved again.
LEVELS = 8


def chunks(text: str) -> list[str]:
    """The text in chunks that the byte-level vocabulary encodes one by one as it would the whole.

    A word takes one space before it along, a line end between other characters is a word of its own, and no word
    holds white space after something else.
    """
    if _ODD.search(text) or any(d in text for d in _DOUBLE):
        return _FRONT.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


def _ranked(path: str):
    """The vocabulary of the file as ranks, which tiktoken applies in half the time, if its ids are in the order of its merges; else None.

    Both libraries then give the same ids for text of letters, digits and white space that all versions of Unicode agree on.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as the character of their number; others from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = file["normalizer"] is None and file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or [model["vocab"][a + b] for a, b in merged] != list(range(256, 256 + len(merged))):
        return None
    ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Encoder(dict):
    """Ids of texts by a tokenizer file; each distinct chunk is encoded once. The first entry is the end of a text."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.tokenizer.get_vocab()  # a character of an entry stands for a byte
        self.ranked = _ranked(path)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[None] = 0
        self.new: list[str] = []
        self.flat, self.at = np.array([self.end_id], np.uint32), np.array([0, 1], np.int64)

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n

    def _ids(self, row: str) -> list[int]:
        if self.ranked is None or _FAR.search(row):
            return self.tokenizer.encode(row, add_special_tokens=False).ids
        return self.ranked.encode(row, allowed_special="all")

    def _learn(self) -> None:
        """Encodes the new chunks; those with a space before something else are encoded in a row, and told apart by their bytes."""
        ends, own = np.cumsum([len(c.encode()) for c in self.new]), [0]
        for n, c in enumerate(self.new):
            if not (c[:1] == " " and c[1:2].strip()) or (n and ends[n - 1] - ends[own[-1]] > ROW_BYTES):
                own.append(n)
        rows = ["".join(self.new[a:b]) for a, b in zip(own, own[1:] + [len(self.new)], strict=True)]
        ids = np.concatenate([np.array(self._ids(row), np.uint32) for row in rows])
        at = np.searchsorted(np.cumsum(self.bytes[ids]), ends, side="right")
        self.at = np.concatenate([self.at, self.at[-1] + at])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end, and where each begins and the last ends."""
        if len(self) > MOST_CHUNKS or len(self.flat) > MOST_TOKENS:
            self.forget()
        found = [np.fromiter(map(self.__getitem__, chain(chunks(t), (None,))), np.int32) for t in texts]
        if self.new:
            self._learn()
        which = np.concatenate(found)
        begin = self.at[which]
        size = self.at[which + 1] - begin
        to = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
        return flat, to[np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each vocabulary of a worker, which serves many tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


def _pieces(path: str, width: int, end_id: int, ids: bool):
    """Pieces of texts: ``rank`` counts the pieces of a length in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = encoder(path, end_id), TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in batches:
            for part in tp.slices(batch, "text"):
                flat, at = own.encode([t or "" for t in part["text"].to_pylist()])
                size = np.diff(at)
                n = -(-size // width)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                end = size[doc] - (n[doc] - 1 - piece) * width  # the first piece is the one that may be shorter
                start = np.maximum(0, end - width)
                length = end - start
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
                rank += seen[length]
                seen += np.bincount(length, minlength=width + 1)
                flat = flat.astype("<u4")
                froms = (at[doc] + start).tolist()
                cut = [flat[a : a + k] for a, k in zip(froms, length.tolist(), strict=True)]
                columns = [part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if ids:
                    columns.append(pa.array([c.tobytes() for c in cut], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def knapsack(price: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to ``width`` the highest price of a set of lengths, and the length taken last (0: none)."""
    best, last = np.zeros(width + 1), np.zeros(width + 1, np.int64)
    for c in range(1, width + 1):
        fits = lengths[: np.searchsorted(lengths, c, side="right")]
        best[c] = best[c - 1]
        last[c] = -1
        if len(fits):
            value = best[c - fits] + price[: len(fits)]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], last[c] = value[k], fits[k]
    return best, last


def configurations(lengths: np.ndarray, price: np.ndarray, width: int, near: float) -> np.ndarray:
    """For each length the configuration of the highest price that holds it, if that is near the highest of all: numbers of each length by row."""
    best, last = knapsack(price, lengths, width)
    chosen = np.flatnonzero(price + best[width - lengths] >= (1 - near) * best[width])
    rows = np.zeros((len(chosen), width + 1), np.int32)
    rows[np.arange(len(chosen)), lengths[chosen]] = 1
    left, who = width - lengths[chosen], np.arange(len(chosen))
    while len(who):
        took = last[left]
        some = took > 0
        np.add.at(rows, (who[some], took[some]), 1)
        left = np.where(some, left - took, left - 1)
        who, left = who[left > 0], left[left > 0]
    return np.unique(rows[:, lengths], axis=0)


def fractional(lengths: np.ndarray, counts: np.ndarray, width: int, seed: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Configurations (which lengths, how many of each), how often to use each to cover about all counts, and what share of a sequence each wastes; multiplicative weights.

    Prices begin as lengths and fall with the share of a length that is covered already. No round covers more than
    a step of any length, and none prices what is a step ahead. Among equal prices fewer pieces come first, so that
    small ones stay for gaps. Waste is against the fullest configuration that there is.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    done, used = np.zeros(len(lengths)), {}
    dual = lengths / knapsack(lengths.astype(float), lengths, width)[0][width]
    for step in range(1, ROUNDS + 1):
        behind = np.flatnonzero(done < min(1.0, step * STEP))
        if not len(behind):
            if done.min() >= 1:
                break
            continue
        price = lengths / width * np.exp(-FALL * (done - done.min()))
        own, n = lengths[behind], counts[behind]
        rows = configurations(own, price[behind] * (1 + rng.uniform(0, JITTER, len(own))) - FEW, width, NEAR)
        rows = rows[(rows <= n).all(axis=1)]
        if not len(rows):
            continue
        uses = (rows > 0).sum(axis=0)
        share = np.where(rows > 0, n / np.maximum(rows * uses, 1), np.inf).min(axis=1) * STEP
        done[behind] += share @ rows / n
        for row, x in zip(rows, share.tolist(), strict=True):
            held = np.flatnonzero(row)
            key = behind[held].astype(np.uint32).tobytes(), row[held].astype(np.uint32).tobytes()
            used[key] = used.get(key, 0.0) + x
    rows = [(np.frombuffer(which, np.uint32).astype(np.int64), np.frombuffer(many, np.uint32).astype(np.int64)) for which, many in used]
    wasted = np.array([1 - float(many @ dual[which]) for which, many in rows])
    return rows, np.array(list(used.values())) / max(1e-9, float(np.average(done, weights=counts * lengths))), wasted


def _fill(lengths: list[int], left: list[int], width: int) -> list[int]:
    """The largest piece left and those that fill its sequence best: a subset sum over what is left, larger pieces first."""
    first = next(i for i in range(len(left) - 1, -1, -1) if left[i])
    take = [0] * len(left)
    take[first] = 1
    room = width - lengths[first]
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for i in range(first, -1, -1):
        k, copies = lengths[i], min(left[i] - take[i], room // lengths[i])
        while copies > 0:
            grown = reach | (reach << k & full)
            if grown == reach:
                break
            steps.append((i, reach))
            reach, copies = grown, copies - 1
        if reach >> room & 1:
            break
    room = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> room & 1:
            take[i] += 1
            room -= lengths[i]
    return take


def solve(histogram: dict[int, int], width: int, seed: int = 1) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of sequences): packs all pieces of the histogram, whose lengths are at least 1 and below ``width``."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    plan: list[tuple[dict[int, int], int]] = []

    rng, waste = np.random.Generator(np.random.PCG64(seed)), WASTE
    for level in range(LEVELS):
        some = np.flatnonzero(left)
        if not len(some):
            break
        before = int(left.sum())
        rows, x, wasted = fractional(lengths[some], left[some], width, seed + level)
        times = np.floor(x + rng.uniform(0, 1, len(x))).astype(np.int64)
        for i in [i for i in np.argsort(-x, kind="stable").tolist() if wasted[i] <= waste]:
            which, many = some[rows[i][0]], rows[i][1]
            n = min(int(times[i]), int((left[which] // many).min()))
            small = lengths <= width - lengths[which] @ many
            if n and left[small] @ lengths[small] <= SMALL * n * width:
                left[which] -= many * n
                plan.append((dict(zip(lengths[which].tolist(), many.tolist(), strict=True)), n))
        if left.sum() > 0.7 * before:
            waste *= 4
    own, rest = lengths.tolist(), left.tolist()
    while any(rest):
        take = _fill(own, rest, width)
        times = max(1, min(r // t for r, t in zip(rest, take, strict=True) if t))
        rest = [r - t * times for r, t in zip(rest, take, strict=True)]
        plan.append(({k: t for k, t in zip(own, take, strict=True) if t}, times))
    return plan


@dataclass
class Plan:
    """Runs of ranks of a length: the first rank, the first sequence, and pieces of the length in a sequence and where they begin."""

    key: np.ndarray  # length and first rank
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, solution: list[tuple[dict[int, int], int]]) -> Plan:
        seen: dict[int, int] = {}
        runs, sequence = [], 0
        for row, times in solution:
            offset = 0
            for length, copies in sorted(row.items(), reverse=True):
                runs.append((length, seen.get(length, 0), sequence, copies, offset))
                seen[length] = seen.get(length, 0) + copies * times
                offset += length * copies
            sequence += times
        runs.sort()
        length, rank, first, copies, offset = np.array(runs, np.int64).reshape(-1, 5).T
        return cls(length << 44 | rank, first, copies, offset, sequence)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        nth = rank - (self.key[at] & (1 << 44) - 1)
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            rest = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in rest), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, width: int = 1024, end_id: int = 2, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and with ``ids`` the ids of each piece as little-endian bytes.

    Each row of ``docs`` is a text of its own, whatever its doc_id, which may be null or repeated; null and empty texts are
    the end alone. Texts of more than ``width`` ids are cut into pieces of ``width``, the first of which may be shorter; a
    piece of ``width`` fills a sequence. The number of sequences depends only on the lengths; which of several pieces
    of one length goes where depends on how rows are partitioned. No documents give no rows. Other columns of
    ``docs`` are not read.
    """
    cols = "doc_id, piece, start, length, ids_crc32" + (", ids" if ids else "")
    schema = PIECES + (", ids binary" if ids else "")
    pieces = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tp.task(_pieces(path, width, end_id, ids)), schema))
    short = pieces.where(F.col("length") < width)
    counts = short.groupBy("task", "length").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Plan.of(solve(histogram, width)))
    ranked = short.join(ahead.select("task", "length", "ahead"), ["task", "length"]).withColumn("rank", F.col("rank") + F.coalesce("ahead", F.lit(0)))
    kinds = dict(pieces.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in cols.split(", ")) + ", sequence_id bigint, offset bigint"
    placed = ranked.selectExpr(*cols.split(", "), "rank").mapInArrow(tp.task(_placed(shared)), out)
    whole = pieces.where(F.col("length") == width).selectExpr(*cols.split(", "), "-1 - (shiftleft(cast(task as bigint), 40) + rank) as sequence_id", "0L as offset")
    return placed.unionByName(whole)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(b"".join(p["ids"] for p in sorted(pieces, key=lambda p: p["offset"])), "<u4").astype(np.int32) for pieces in batch["pieces"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "ids"])


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>) of what :func:`pack` gives with ``ids``: a row for each sequence, none longer than the width."""
    rows = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("pieces"))
    return rows.mapInArrow(tp.task(_joined), "sequence_id bigint, ids array<int>")
