"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that a task holds before it passes their counts on.
MOST_TERMS = 500_000

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and ``_``; each CJK character is a token of its own.

    ASCII is told first, since the script of a character takes long to look up.
    """
    wide = r"\x{80}-\x{10FFFF}"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[A-Za-z0-9_[{wide}&&[\p{{L}}\p{{Nd}}]&&[^{CJK}]]]+|[{wide}&&[{CJK}]]"), F.lit(0))


def term_counts(rows: DataFrame, lowered: str) -> DataFrame:
    """(term, df, tf) of texts in lower case, with the terms of :func:`tokens`: each task counts the terms of its texts before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cjk = CJK.replace("Is", "")
        word = regex.compile(rf"[{cjk}]|[[\p{{L}}\p{{Nd}}_]--[{cjk}]]+", regex.V1)
        df: Counter[str] = Counter()
        tf: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            terms = list(tf)
            rows = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([df[t] for t in terms], pa.int64()), pa.array([tf[t] for t in terms], pa.int64())], ["term", "df", "tf"])
            df.clear()
            tf.clear()
            return rows

        for batch in batches:
            for text in batch[0].to_pylist():
                own = Counter(word.findall(text or ""))
                tf.update(own)
                df.update(own.keys())
                if len(tf) > MOST_TERMS:
                    yield out()
        yield out()

    return rows.select(lowered).mapInArrow(count, "term string, df bigint, tf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def compact(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def snippet(text: Column, phrase: Column, terms: Column, size: int = 240) -> Column:
    """Up to ``size`` characters around the phrase, else around the first term, with dots where it is cut."""
    flat = compact(text)
    low = F.lower(flat)
    first = F.get(F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.instr(low, t)), lambda p: p > 0), F.lit(0))
    found = F.coalesce(F.when(F.instr(low, F.lower(phrase)) > 0, F.instr(low, F.lower(phrase))), first, F.lit(1)) - 1
    begin = F.greatest(F.lit(0), F.least(F.greatest(found - size // 2, F.lit(0)), F.length(flat) - size))
    body = F.substring(flat, begin + 1, F.lit(size))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(begin + size < F.length(flat), "...").otherwise(""))
    return F.when(F.length(flat) <= size, flat).otherwise(cut)


def token_estimate(text: Column) -> Column:
    """The larger of the characters and a quarter of the bytes, rounded up."""
    return F.greatest(F.length(text), F.ceil(F.octet_length(text) / 4)).cast("bigint")


def slug(text: Column, size: int = 60) -> Column:
    """Letters and digits of ASCII and CJK, joined by single hyphens."""
    out = F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(F.regexp_replace(out, "^-+|-+$", ""), F.lit(size)), "-+$", ""), F.lit("")), F.lit("topic"))


def provider(model: Column) -> Column:
    """What stands before the slash of a model's name, else ``default``."""
    return F.when(F.instr(model, "/") > 1, F.substring_index(model, "/", 1)).otherwise("default")


def clip(text: Column, width: int) -> Column:
    """Up to ``width`` graphemes; a longer text loses its end to an ellipsis."""
    return F.when(text.rlike(rf"^(?s:\X){{{width + 1}}}"), F.concat(F.regexp_extract(text, rf"^((?s:\X){{{width - 1}}})", 1), F.lit("…"))).otherwise(text)


def tick_step(top: Column, target: int) -> Column:
    """A step of 1, 2 or 5 times a power of ten, so that about ``target`` of them reach ``top``."""
    raw = F.greatest(top, F.lit(1.0)) / target
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / power
    return F.when(top <= target, F.lit(1.0)).otherwise(F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10) * power)


def tick_label(n: Column) -> Column:
    """Thousands and millions with at most one place."""
    short = lambda x, unit: F.concat(F.regexp_replace(F.round(x, 1).cast("string"), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(n / 1_000_000, "m")).when(n >= 1_000, short(n / 1_000, "k")).otherwise(F.round(n).cast("bigint").cast("string"))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def query_language(text: Column) -> Column:
    return F.when(text.rlike(f"[{CJK}]"), "zh-CN").otherwise("en")


def document_language(text: Column) -> Column:
    """Chinese from a hundred CJK characters on, if they are more than a fifth of the letters."""
    cjk = F.when(text.rlike(f"[{CJK}]"), _count(text, CJK)).otherwise(0)
    return F.when((cjk > 100) & (cjk * 4 > _count(text, r"\p{IsLatin}")), "zh-CN").otherwise("en")
