"""Where queries and the SQL that states their results are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function of (spark, sf_dir) under ``name``; ``dates`` are given out as ISO text on both sides."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})

        QUERIES[name] = run if dates else f
        if sql is not None:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'strftime({c}, {chr(39)}%Y-%m-%d{chr(39)}) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add
