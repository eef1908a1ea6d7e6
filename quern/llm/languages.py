"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each language has a Bloom filter of the n-grams that make up at least ``rarest`` of its
training text, so a filter never holds more than ``1 / rarest`` n-grams for each length.
The filters are sliced: place ``p`` of 64 of them is one integer, bit ``i`` of which
belongs to language ``i``; each further 64 languages have an integer more. Two places are looked up for an n-gram and their integers are
anded, which gives at once every language whose filter has it. For each language the
bits of a text are counted, and the share of false positives that its filter's fill lets
expect is taken out; the largest share decides, the first name among equals.

Training reads a bounded sample: about ``per_lang`` documents of each language outside the
held-out fold, and all languages. Prediction reads whole
texts. Null texts, and texts without a letter (as Unicode has it), are ``und`` with score 0, as is every text
if nothing could be learned. Repeated rows are judged alike; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import folds
from quern.llm import textpack as tp
from quern.llm.store import materialise

LENGTHS = (3, 5)
#: Bits of a filter; two places are set for each n-gram.
BITS = 1 << 21
SLICE = 64

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
#: Bytes of non-letters outside ASCII that are common in Latin text: the lead byte of punctuation and signs.
_LETTER[0xC2] = 0


def ngrams(part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the text and the hash of every n-gram of letters with at most one gap.

    Letters are lower-cased in ASCII and Latin-1; all else between words is one gap byte.
    """
    buf, off = tp.buffers(part["text"])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    low = _LETTER[buf]
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    low = np.where(after & (low >= 0x80) & (low <= 0x9E), low + 0x20, low)
    # A second gap byte in a row is dropped, also across texts.
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0) | (doc[1:] != doc[:-1])
    low, doc = low[keep].astype(np.uint64), doc[keep]
    out = []
    for n in LENGTHS:
        m = len(low) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        x = np.full(m, np.uint64(n << 56))
        for k in range(n):
            x = x | (low[k : k + m] << np.uint64(8 * k))
        own = doc[:m] == doc[n - 1 :]
        out.append((doc[:m][own], tp.mix(x[own])))
    return out


def _count(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([place[x] for x in batch["lang"].to_pylist()], np.int64)
            at = 0
            for part in tp.slices(batch, "text"):
                own = lang[at : at + part.num_rows]
                at += part.num_rows
                for n, (doc, h) in zip(LENGTHS, ngrams(part), strict=True):
                    for i in np.unique(own):
                        grams, times = np.unique(h[own[doc] == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i)), pa.array(np.full(len(grams), n)), pa.array(grams.view(np.int64)), pa.array(times)], ["lang_no", "n", "gram", "times"])

    return run


def train(docs: DataFrame, learnable: Column, per_lang: int = 1500, rarest: float = 1 / 40_000) -> dict:
    """Filters of all languages; ``docs`` has doc_id, text and lang."""
    rows = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    # One row of integers for each slice of languages.
    filters = np.zeros((-(-len(langs) // SLICE), BITS), np.uint8 if len(langs) <= 8 else np.uint64)
    model = {"langs": langs, "filters": filters, "false": np.zeros(len(langs))}
    if not langs:
        return model
    taken = folds.sample(rows, "lang", per_lang)
    counts = taken.select("lang", "text").mapInArrow(tp.task(_count(langs)), "lang_no bigint, n bigint, gram bigint, times bigint").groupBy("lang_no", "n", "gram").agg(F.sum("times").alias("times"))
    total = counts.groupBy("lang_no", "n").agg(F.sum("times").alias("total"))
    grams = counts.join(F.broadcast(total), ["lang_no", "n"]).where(F.col("times") >= F.greatest(F.lit(2.0), F.col("total") * rarest)).select("lang_no", "gram")
    if len(filters) > 1:
        grams = materialise(grams)
    for k, own in enumerate(filters):
        # A filter is made where its n-grams are; 64 of them (a quarter of a megabyte each) come back at a time.
        some = grams.where((F.col("lang_no") >= k * SLICE) & (F.col("lang_no") < (k + 1) * SLICE))
        for r in some.groupBy("lang_no").applyInPandas(_filter, "lang_no bigint, bits binary").collect():
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(own.dtype)
            own |= bits << own.dtype.type(r.lang_no % SLICE)
            model["false"][r.lang_no] = np.mean(bits) ** 2
    return model


def _filter(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BITS, bool)
    for p in _places(rows["gram"].to_numpy(np.int64).view(np.uint64)):
        bits[p] = True
    return pd.DataFrame({"lang_no": [rows["lang_no"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(BITS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64)


def predict(part: pa.RecordBatch, model: dict) -> tuple[list[str], np.ndarray]:
    langs, filters, n = model["langs"], model["filters"], part.num_rows
    grams = ngrams(part)
    hits, seen = np.zeros((n, max(1, len(langs)))), np.zeros(n)
    for doc, h in grams:
        a, b = _places(h)
        first = np.searchsorted(doc, np.arange(n + 1))
        seen += np.diff(first)
        for k, own in enumerate(filters):
            mask = own[a] & own[b]
            for i in range(k * SLICE, min((k + 1) * SLICE, len(langs))):
                hits[:, i] += tp.doc_sums((mask >> mask.dtype.type(i % SLICE) & mask.dtype.type(1)).astype(np.int64), first)
    share = hits / np.maximum(seen, 1)[:, None]
    if langs:
        share = np.clip((share - model["false"]) / (1 - model["false"]), 0, 1)
    best = share.argmax(axis=1)
    top = share[np.arange(n), best]
    rest = share.copy()
    rest[np.arange(n), best] = 0
    known = part["letter"].to_numpy(zero_copy_only=False) & bool(langs)
    score = np.where(known, np.where(top > 0, top / np.maximum(top + rest.max(axis=1), 1e-9), 0), 0)
    return [langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)], score


def identify(docs: DataFrame, held_out_mod: int = 3, held_out: int = 1, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score. Learns from ``lang_col`` outside the held-out fold only."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    fold = folds.remainder("doc_id", held_out_mod) == held_out
    model = docs.sparkSession.sparkContext.broadcast(train(docs, ~fold, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text", 1 << 20):
                lang, score = predict(part, model.value)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", fold.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(tp.task(run), "doc_id bigint, held_out boolean, lang_pred string, score double")
