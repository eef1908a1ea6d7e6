"""Quality rules from how public tokenisers cut a text.

Measures are taken of every whole text: with a vocabulary of pieces, characters per token, the share of
tokens that are single bytes, and the entropy of the tokens; with a vocabulary of bytes, characters per token of
its words. Entropy grows with length, so what counts is the gap to a curve in the logarithm of the length.

The corpus itself, all of it, sets curves and bands: per language, per script, and for all texts. A text is held against the
first of these that has at least ``least`` texts; the group of all has bands whatever its size. Distinct texts that pass the base rules count, each once, so copies have no
weight. The middle of a band is that of the shortest interval that holds half of the values, and its reach on either
side is a multiple of half that interval's length: texts of another kind, up to nearly half of a group, do not move it. A
curve goes through the middles of classes of length, and a class that lies apart has little weight.
A text outside a band of its group is rejected. The base counts come first, and a
text that fails them is rejected whatever its measures.

Null texts count as empty: all counts are 0 and the base rule fails. Repeated rows are
judged alike, extra columns are ignored, whatever their names, an empty table gives no rows, and very long texts are measured whole.
Of two shortest intervals the lower one is taken.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import pieces
from quern.llm import textpack as tp
from quern.llm.store import materialise
from quern.llm.store import measured as store_measured

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_SPACES = " \t\n\v\f\r"

SCRIPTS = ["none", "Latin", "Greek", "Cyrillic", "Semitic", "Indic", "Kana", "Han", "Hangul", "other"]
#: Script by the first byte of a character.
_SCRIPT_OF = np.zeros(256, np.int64)
for _low, _high, _script in ((65, 90, 1), (97, 122, 1), (0xC3, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD5, 9), (0xD6, 0xDD, 4), (0xE0, 0xE0, 5), (0xE1, 0xE1, 9), (0xE3, 0xE3, 6), (0xE4, 0xE9, 7), (0xEA, 0xED, 8)):
    _SCRIPT_OF[_low : _high + 1] = _script

COLUMNS = (
    "doc_id bigint, lang string, content bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "script string, n_tokens bigint, chars_per_token double, byte_share double, entropy double, word_chars_per_token double"
)
#: How many half lengths of the shortest half a band reaches below and above its middle, and the least such half length.
BANDS = {"chars_per_token": (8.0, 10.0, 0.01), "byte_share": (math.inf, 12.0, 0.001), "entropy_gap": (4.5, 12.0, 0.05), "word_chars_per_token": (8.0, 10.0, 0.01)}
#: Shares at which values are read off to find the shortest half.
_GRID = [k / 40 for k in range(41)]
#: Groups up to which their bands are sent to all tasks (a few hundred bytes each); with more they are joined.
MAX_BROADCAST = 50_000
#: Words whose tokens a Python worker remembers (about 30 MB); beyond, it begins anew.
MOST_KNOWN = 300_000


class WordCounter:
    """Tokens of single words under a byte-level vocabulary, whose pattern begins a new token at every space anyway."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(x): int(n) for x, n in (line.split() for line in ranks.splitlines() if line)}
        self.code = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[int, int] = {}
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for token, n in table.items():
            self.length[n] = len(token)

    def per_text(self, w: tp.Words) -> np.ndarray:
        """Tokens of the words of each text. The different words of a slice are cut in one go; the lengths of the tokens tell whose they are."""
        if not len(w.start):
            return np.zeros(len(w.first) - 1, np.int64)
        some, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        n = np.array([self.known.get(h, 0) for h in some.tolist()], np.int64)
        new = np.flatnonzero(n == 0)
        if len(new):
            raw = w.buf.tobytes()
            words = [raw[a:b] for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)]
            size = self.length[np.array(self.code.encode_ordinary((b" " + b" ".join(words)).decode()), np.int64)]
            begin = np.cumsum(size) - size
            first = np.cumsum([0, *(len(x) + 1 for x in words[:-1])])
            n[new] = np.diff(np.append(np.searchsorted(begin, first), len(begin)))
            self.known.update(zip(some[new].tolist(), n[new].tolist(), strict=True))
        return tp.doc_sums(n[inverse], w.first)


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return n


def measure(part: pa.RecordBatch, code: pieces.Coder, words: WordCounter) -> pa.RecordBatch:
    w = tp.split(part["text"])
    n = part.num_rows
    texts = [t or "" for t in part["text"].to_pylist()]
    char = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
    word_chars = tp.doc_sums(char[w.end] - char[w.start], w.first)
    at, h = w.windows(3)
    _, inverse, count = np.unique(tp.mix(h + w.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    repeat = tp.doc_sums(tp.covered(len(w.start), again, np.full(len(again), 3)), w.first)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[w.buf])])
    letters = np.zeros((n, len(SCRIPTS)), np.int64)
    for k in range(1, len(SCRIPTS)):
        c = np.concatenate([[0], np.cumsum(_SCRIPT_OF[w.buf] == k)])
        letters[:, k] = np.diff(c[w.off])
    ids, _ = code.encode(texts)
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(n), size)
    byte = np.bincount(doc, weights=code.is_byte[flat], minlength=n)
    key, times = np.unique(doc * code.vocabulary + flat, return_counts=True)
    own = key // code.vocabulary
    p = times / np.maximum(size[own], 1)
    bits = -np.bincount(own, weights=p * np.log2(p), minlength=n).astype(np.float64)  # of no tokens numpy makes integers
    some = np.maximum(size, 1)
    return pa.RecordBatch.from_arrays(
        [
            part["doc_id"], part["lang"], part["content"], pa.array(w.counts), pa.array(word_chars), pa.array(np.diff(symbols[w.off])), pa.array([_dup_lines(t) for t in texts], pa.int64()), pa.array(repeat),
            pa.array([SCRIPTS[k] for k in letters.argmax(axis=1)], pa.string()), pa.array(size),
            pa.array(np.diff(char[w.off]) / some), pa.array(byte / some), pa.array(bits), pa.array(word_chars / np.maximum(words.per_text(w), 1)),
        ],
        names=[c.split()[0] for c in COLUMNS.split(", ")],
    )


_counters: dict[int, WordCounter] = {}


def _measures(model, ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, key = pieces.coder(model), hash(ranks.value)
        if key not in _counters:  # one for each Python worker
            _counters[key] = WordCounter(ranks.value, pattern)
        for batch in batches:
            for part in tp.slices(batch, "text", 1 << 20):
                yield measure(part, code, _counters[key])

    return run


def judge(docs: DataFrame, model_path: str, ranks_path: str, pattern: str, reach: dict[str, tuple[float, float, float]] = BANDS, least: int = 100, max_broadcast: int = MAX_BROADCAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the base counts, the measures with the group they are held against, base_failed, reasons and kept."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).withColumn("content", F.xxhash64("text"))
    # One scan makes the narrow table of measures that curves, bands and verdicts are read from.
    counted = rows.mapInArrow(tp.task(_measures(pieces.load(docs, model_path), pieces.load(docs, ranks_path), pattern)), COLUMNS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialise(counted.withColumn("base_failed", failed))
    found, seen = measured_bands(measured.where("not base_failed"), reach, least)
    send = F.broadcast if seen["n"] <= max_broadcast else lambda d: d
    table = lambda name: send(found.select(F.col("fertility_group").alias(name), F.struct("*").alias(f"{name}_band")))
    one = F.broadcast(found.where("fertility_group = 'all'").select(F.struct("*").alias("every_band")))  # one row
    held = measured.withColumn("own", F.concat(F.lit("lang:"), "lang")).withColumn("script_own", F.concat(F.lit("script:"), "script"))
    held = held.join(table("own"), "own", "left").join(table("script_own"), "script_own", "left").join(one, how="left").withColumn("band", F.coalesce("own_band", "script_own_band", "every_band"))
    held = held.withColumn("fertility_group", F.col("band.fertility_group")).withColumn("entropy_gap", _gap("band."))
    reasons = [F.when(F.col("base_failed"), F.lit("base"))]
    for m in reach:
        # Short texts scatter more.
        value, room = F.col(m), F.sqrt(F.greatest(F.lit(1.0), 1000.0 / F.greatest("n_tokens", F.lit(1)))) if m != "entropy_gap" else F.lit(1.0)
        reasons += [F.when(value < F.col(f"band.{m}_mid") - room * F.col(f"band.{m}_low"), F.lit(f"low_{m}")), F.when(value > F.col(f"band.{m}_mid") + room * F.col(f"band.{m}_high"), F.lit(f"high_{m}"))]
    out = held.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("kept", F.size("reasons") == 0)
    return out.drop("own", "script_own", "own_band", "script_own_band", "every_band", "band", "content")


def _gap(of: str) -> Column:
    x = F.log2(F.col("n_tokens") + 1.0)
    return F.col("entropy") - (F.col(f"{of}c0") + F.col(f"{of}c1") * x + F.col(f"{of}c2") * x * x)


def shortest_half(values: list[float]) -> tuple[float, float]:
    """Middle and half length of the shortest interval that holds half of the values, which are given at the shares of _GRID."""
    half = len(values) // 2
    at = min(range(len(values) - half), key=lambda i: (values[i + half] - values[i], i))
    return (values[at] + values[at + half]) / 2, (values[at + half] - values[at]) / 2


def _shortest(values: Column) -> Column:
    """The same of an array column: a struct of width, mid and half."""
    n = len(_GRID) // 2
    all_of = [F.struct((values[i + n] - values[i]).alias("width"), F.lit(i).alias("i"), ((values[i] + values[i + n]) / 2).alias("mid"), ((values[i + n] - values[i]) / 2).alias("half")) for i in range(len(_GRID) - n)]
    return F.array_min(F.array(*all_of))


def measured_bands(good: DataFrame, reach: dict[str, tuple[float, float, float]], least: int) -> tuple[DataFrame, dict]:
    """Curve and bands of every group with at least ``least`` distinct texts, and of all texts; and how many groups there are."""
    values = [m for m in reach if m != "entropy_gap"]
    distinct = good.groupBy("content").agg(F.min("lang").alias("lang"), F.min("script").alias("script"), F.min("n_tokens").alias("n_tokens"), F.min("entropy").alias("entropy"), *(F.min(m).alias(m) for m in values))
    names = F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"), F.lit("all")))
    grouped = materialise(distinct.select(F.explode(names).alias("fertility_group"), "n_tokens", "entropy", *values))
    # Middles of classes of length, half a power of two each, and the curve through them.
    x = F.log2(F.col("n_tokens") + 1.0)
    middles = grouped.groupBy("fertility_group", F.round(2 * x).alias("class")).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.percentile_approx("entropy", _GRID, 2000).alias("q"))
    middles = middles.select("fertility_group", "n", "x", _shortest(F.col("q"))["mid"].alias("y"))
    curves = middles.groupBy("fertility_group").applyInPandas(_curve, "fertility_group string, texts bigint, c0 double, c1 double, c2 double").where((F.col("texts") >= least) | (F.col("fertility_group") == "all"))
    gaps = grouped.join(curves, "fertility_group").withColumn("entropy_gap", _gap(""))
    q = gaps.groupBy("fertility_group").agg(*(F.first(c).alias(c) for c in ("texts", "c0", "c1", "c2")), *(F.percentile_approx(m, _GRID, 2000).alias(m) for m in reach))
    q = q.withColumns({m: _shortest(F.col(m)) for m in reach})
    bands = [c.alias(name) for m, (low, high, floor) in reach.items() for half in [F.greatest(F.col(f"{m}.half"), F.lit(floor))] for name, c in ((f"{m}_mid", F.col(f"{m}.mid")), (f"{m}_low", half * low), (f"{m}_high", half * high))]
    return store_measured(q.select("fertility_group", "texts", "c0", "c1", "c2", *bands), n=F.count(F.lit(1)))


def _curve(rows: pd.DataFrame) -> pd.DataFrame:
    """Entropy as 1, x and x * x by least absolute gaps, class by class with the root of its texts as weight; a few rows a group."""
    x, y, n = (rows[c].to_numpy(np.float64) for c in ("x", "y", "n"))
    z = np.stack([np.ones(len(x)), x, x * x], axis=1)[:, : min(3, len(x))]
    weight = np.sqrt(n)
    for _ in range(30):
        root = np.sqrt(weight)[:, None]
        c = np.linalg.lstsq(z * root, y * root[:, 0], rcond=None)[0]
        weight = np.sqrt(n) / np.maximum(np.abs(y - z @ c), 1e-3)
    c = np.append(c, np.zeros(3 - len(c)))
    return pd.DataFrame({"fertility_group": [rows["fertility_group"].iloc[0]], "texts": [int(n.sum())], "c0": c[0], "c1": c[1], "c2": c[2]})
