"""Path patterns as regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` stay inside a path segment, ``**`` crosses them."""
    marks = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(marks.get(p) or re.escape(p) for p in re.split(r"(\*\*|\*|\?)", pattern) if p) + "$"


def glob_set(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of the included patterns (all, if there is none) and none of the excluded ones."""
    hit = reduce(lambda a, p: a | path.rlike(glob_regex(p)), include, F.lit(not include))
    return hit & ~reduce(lambda a, p: a | path.rlike(glob_regex(p)), exclude, F.lit(False))
