"""Lines added and removed between two texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Changed lines beyond which the order of lines is not looked at.
MAX_EDITS = 2000


def lines_of(text: str) -> list[str]:
    """Lines without their ends; an empty text has none, and a last newline begins none."""
    return text.removesuffix("\n").split("\n") if text else []


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def tally(old: str, new: str) -> tuple[bool, int, int]:
    """(binary, added, removed); binary texts and equal ones have no changes."""
    if "\0" in old or "\0" in new:
        return True, 0, 0
    a, b = lines_of(old), lines_of(new)
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) + len(b) > MAX_EDITS:
        x, y = Counter(a), Counter(b)
        return False, sum((y - x).values()), sum((x - y).values())
    number = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    same = _common(np.array([number[s] for s in a], np.int64), np.array([number[s] for s in b], np.int64)) if a and b else 0
    return False, len(b) - same, len(a) - same


@F.pandas_udf(T.StructType([T.StructField("binary", T.BooleanType()), T.StructField("added", T.LongType()), T.StructField("removed", T.LongType())]))
def _tallies(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([tally(a or "", b or "") for a, b in zip(old, new, strict=True)], columns=["binary", "added", "removed"])


def tallies(old: Column, new: Column) -> Column:
    return _tallies(old, new)
