"""Operators that need Python for each row: chunks and marked-up text. Arrow batches, no state between rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import chunking, declarations, markup
from quern.operators import batches
from quern.plans.registry import query
from quern.sources.tables import table

CHUNKS = "doc_id bigint, first_line int, last_line int, content string"


def chunks(docs: DataFrame, cut) -> DataFrame:
    """Rows of (doc_id, first_line, last_line, content) for each text, as ``cut`` says."""
    batches.bounded(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(d, *c) for d, t in zip(p["doc_id"], p["text"], strict=True) for c in cut(t or "")], columns=["doc_id", "first_line", "last_line", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNKS)


@query("r01_chunks")
def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole lines by size."""
    return chunks(table(spark, sf_dir, "documents"), chunking.by_size).withColumn("hash", F.sha2("content", 256))


@query("r02_structural_chunks")
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks filled with whole declarations, as the scanners of indented and of braced languages find them."""
    return chunks(table(spark, sf_dir, "documents"), lambda t: chunking.structural(t, declarations.find(t, ".py") or declarations.find(t, ".js")))


_GO = """package orders

// Order%1$d has a state, not a {.
type Order%1$d struct {
\ttotal float64
}

const State%1$d = `%2$s{"`

func (o *Order%1$d) Customer() int {
\tif o.total > 0 { // }
\t\treturn %3$d
\t}
\treturn '{'
}

func New%1$d(
\ttotal float64,
) *Order%1$d {
\treturn &Order%1$d{total: total}
}
"""
_JS = """// {
export class Order%1$d extends Base {
  /* the state: } */
  state(quote = "'{") {
    return /[{"]/.test(quote) ? '%2$s' : `${ {a: 1} }`
  }

  customer() {
    return %3$d
  }
}

function total%1$d(a) {
  return a / 2 / 3
}
"""


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ext, source): a source file for each order, in one of two languages."""
    text = lambda form: F.format_string(form, F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey"))
    go = F.col("o_orderkey") % 2 == 0
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.when(go, ".go").otherwise(".js").alias("ext"), F.when(go, text(_GO)).otherwise(text(_JS)).alias("source"))


@query(
    "r03_declarations",
    """SELECT o_orderkey AS file, first_line, last_line, depth FROM orders
    JOIN (VALUES (0, 3, 6, 0), (0, 10, 15, 0), (0, 11, 13, 1), (0, 17, 21, 0), (1, 1, 11, 0), (1, 3, 6, 1), (1, 8, 10, 1), (1, 13, 15, 0)) d (odd, first_line, last_line, depth) ON o_orderkey % 2 = odd""",
)
def file_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarations of source files and how deep they lie."""

    def rows(found: list[declarations.Declaration], depth: int = 0) -> Iterator[tuple[int, int, int]]:
        for d in found:
            yield d.start, d.end, depth
            yield from rows(d.members, depth + 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(f, *r) for f, e, t in zip(p["file"], p["ext"], p["source"], strict=True) for r in rows(declarations.find(t, e) or [])], columns=["file", "first_line", "last_line", "depth"])

    return code(spark, sf_dir).mapInPandas(run, "file bigint, first_line int, last_line int, depth int")


@query(
    "r07_go_symbols",
    """SELECT o_orderkey AS file, replace(name, '#', o_orderkey::VARCHAR) AS name, kind, line, replace(parent, '#', o_orderkey::VARCHAR) AS parent, replace(signature, '#', o_orderkey::VARCHAR) AS signature FROM orders,
    (VALUES ('Order#', 'struct', 4, '', 'struct Order#'), ('State#', 'const', 8, '', 'const State#'), ('Customer', 'method', 10, 'Order#', 'func (Order#) Customer() int'),
            ('New#', 'func', 17, '', 'func New#( total float64, ) *Order#')) s (name, kind, line, parent, signature) WHERE o_orderkey % 2 = 0""",
)
def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, methods with their receivers, types, constants and variables of Go files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(f, *s) for f, t in zip(p["file"], p["source"], strict=True) for s in declarations.go_symbols(t)], columns=["file", "name", "kind", "line", "parent", "signature"])

    return code(spark, sf_dir).where("ext = '.go'").mapInPandas(run, "file bigint, name string, kind string, line int, parent string, signature string")


@query("f16_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: pages as text with light marks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"page_id": p["page_id"], "text": p["html"].map(markup.to_text)})

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id bigint, text string")
