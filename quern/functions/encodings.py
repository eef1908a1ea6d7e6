"""Telling the encoding of bytes, and reading them as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that decide whether a file is binary.
PEEK = 8192


def kind(data: bytes) -> str:
    """By its mark, else as what it can be read; zero bytes without a mark are binary."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-bom"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return name
    if b"\0" in data[:PEEK]:
        return "binary"
    for name in ("utf-8", "gb18030"):
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            pass
    return "lossy-utf-8"


_CODECS = {"utf-8-bom": "utf-8-sig", "utf-16le": "utf-16", "utf-16be": "utf-16", "lossy-utf-8": "utf-8"}


def _read(data: bytes | None) -> tuple[str | None, str | None]:
    if data is None:
        return None, None
    found = kind(bytes(data))
    return found, None if found == "binary" else bytes(data).decode(_CODECS.get(found, found), "replace")


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))
def _decoded(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x) for x in data], columns=["kind", "text"])


def decoded(data: Column) -> Column:
    """``kind`` and ``text`` of bytes; binary ones and null have no text. Plain UTF-8 never leaves the JVM."""
    marked = F.hex(F.substring(data, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    plain = F.is_valid_utf8(data.cast("string")) & ~marked & (F.instr(F.hex(F.substring(data, 1, PEEK)), "00") == 0)
    return F.when(data.isNull() | ~plain, _decoded(F.when(~plain, data))).otherwise(F.struct(F.lit("utf-8").alias("kind"), data.cast("string").alias("text")))


@F.pandas_udf(T.BinaryType())
def encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.encode(c, "replace") for t, c in zip(text, codec, strict=True)])
