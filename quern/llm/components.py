"""Connected components of an undirected graph of integers, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import measured


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written down, and what tells them from other sets of edges."""
    rows, seen = measured(edges, n=F.count(F.lit(1)), mark=F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))))
    return rows, (seen["n"], seen["mark"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b) but those with edges to themselves only: the smallest node that it is connected with.

    A round hangs every larger neighbour of a node on the node's smallest one, then every smaller
    neighbour; the graph is a forest of stars when a round changes nothing. A round writes its edges once.
    """
    now, mark = _kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while mark != before and mark[0]:
        before = mark
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(now.select("b", "a"))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select(F.col("node").alias("b"), F.least("node", "other").alias("least"))
        # Both uses of the large stars read one exchange.
        large = now.join(least, "b").select("a", F.col("least").alias("b")).repartition("a")
        lower = large.join(large.groupBy("a").agg(F.min("b").alias("least")), "a")
        ends = F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))
        now, mark = _kept(lower.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select("b", "b").distinct())
