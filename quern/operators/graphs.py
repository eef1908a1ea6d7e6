"""Depths, roots, strong components, cycles and orders of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def _doubled(links: DataFrame, most: int = 64) -> DataFrame:
    """(node, top, steps) of a forest (node, up; null at a root): each round doubles how far a link reaches."""
    at = cut(links.select("node", F.coalesce("up", "node").alias("top"), F.col("up").isNotNull().cast("bigint").alias("steps")))
    for _ in range(most):
        up = at.select(F.col("node").alias("top"), F.col("top").alias("far"), F.col("steps").alias("more"))
        at = cut(at.join(up, "top").select("node", F.col("far").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("node", "top", "steps")
        at = at.drop("moved")
    raise ValueError("links run in a cycle")


def depths(links: DataFrame) -> DataFrame:
    return _doubled(links).select("node", F.col("steps").alias("depth"))


def roots(links: DataFrame) -> DataFrame:
    return _doubled(links).select("node", F.col("top").alias("root"))


def _ends(links: DataFrame) -> DataFrame:
    """(node, top, steps, least, endless) of links (node, up), one for each node: where they lead to, the last of which has no link of its own.

    Each round doubles how far a link reaches. Links that run in a ring are ``endless``; ``least`` is then the smallest node of the ring.
    """
    at = cut(links.select("node", F.col("up").alias("top"), F.lit(1).cast("bigint").alias("steps"), F.least("node", "up").alias("least")))
    far, n = 1, at.count()
    while True:
        up = at.select(F.col("node").alias("top"), F.col("top").alias("far"), F.col("steps").alias("more"), F.col("least").alias("lower"))
        at = cut(at.join(up, "top", "left").select("node", F.coalesce("far", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("least", "lower").alias("least"), F.col("far").isNotNull().alias("endless")))
        far *= 2
        if far > 2 * n or at.where("endless").isEmpty():
            return at
        at = at.drop("endless")


def _compressed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) in which a run of nodes with one edge in and one out is a single edge of its length, and the nodes so left out: (node, top, bottom, steps, ring)."""
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n_in"), F.min("a").alias("prev"), F.min("w").alias("w"))
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_out"), F.min("b").alias("next"))
    runs = cut(into.join(out, "node").where("n_in = 1 and n_out = 1 and prev != node").select("node", "prev", "next", "w"))
    if runs.isEmpty():
        return edges, runs.select("node", F.col("prev").alias("top"), F.col("next").alias("bottom"), F.col("w").alias("steps"), F.lit(None).cast("bigint").alias("ring"))
    up = _ends(runs.select("node", F.col("prev").alias("up")))
    down = _ends(runs.select("node", F.col("next").alias("up"))).select("node", F.col("top").alias("bottom"), F.col("steps").alias("below"))
    held = cut(up.join(down, "node").select("node", "top", "bottom", "steps", "below", F.when(F.col("endless"), F.col("least")).alias("ring")))
    short = held.where("ring is null").groupBy("top", "bottom").agg(F.max(F.col("steps") + F.col("below")).alias("w"))
    names = runs.select("node")
    rest = edges.join(names.withColumnRenamed("node", "a"), "a", "left_anti").join(names.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b", "w")
    return cut(rest.unionByName(short.select(F.col("top").alias("a"), F.col("bottom").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))), held.drop("below")


def _grown(start: DataFrame, step, merged) -> DataFrame:
    """Applies ``step`` to what was new in the last round until nothing is; ``merged`` makes one table of the old and the new, with a column ``new``."""
    now = cut(start.withColumn("new", F.lit(True)))
    while True:
        fresh = now.where("new").drop("new")
        if fresh.isEmpty():
            return now.drop("new")
        now = cut(merged(now.drop("new"), step(fresh)))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), any number of them each way: the smallest of the nodes that each is reached from and reaches.

    Nodes that nothing leads to or that lead nowhere are components of their own and are trimmed; runs of nodes with one edge in and one out
    are compressed by doubling. So tails, however long, and trees cost a logarithm of rounds. What is left is coloured: each node by the largest node
    that reaches it, then back from that node within its colour. Those rounds grow with the width of what is left, not with the tails.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    left = cut(edges.where("a != b").distinct().withColumn("w", F.lit(1).cast("bigint")))
    found: list[DataFrame] = []  # of more nodes than one
    runs: list[DataFrame] = []
    while not left.isEmpty():
        before = None
        while before != (before := left.count()):
            sources, sinks = left.select("a").distinct(), left.select("b").distinct()
            left = cut(left.join(sinks.withColumnRenamed("b", "a"), "a", "left_semi").join(sources.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "w"))
            if left.isEmpty():
                break
            left, held = _compressed(left)
            left = left.where("a != b")
            runs.append(held)
        if left.isEmpty():
            break
        start = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("colour", F.col("node"))
        onward = lambda fresh: left.join(fresh.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("more"))  # noqa: E731, B023
        coloured = _grown(start, onward, lambda now, more: now.join(more, "node", "left").select("node", F.greatest("colour", "more").alias("colour"), (F.coalesce("more", "colour") > F.col("colour")).alias("new")))
        of = lambda name: coloured.select(F.col("node").alias(name), F.col("colour").alias(f"{name}_colour"))  # noqa: E731, B023
        own = cut(left.join(of("a"), "a").join(of("b"), "b").where("a_colour = b_colour").select("a", "b", "w", F.col("a_colour").alias("colour")))
        backward = lambda fresh: own.join(fresh.withColumnRenamed("node", "b"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()  # noqa: E731, B023
        reached = _grown(coloured.where("node = colour"), backward, lambda now, more: now.withColumn("new", F.lit(False)).unionByName(more.join(now, "node", "left_anti").withColumn("new", F.lit(True))))
        found.append(reached)
        left = cut(own.join(reached.select(F.col("node").alias("a")), "a", "left_anti").join(reached.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b", "w"))
    of = nodes.withColumn("component", F.col("node"))
    for part in found:
        of = of.join(part, "node", "left").select("node", F.coalesce("colour", "component").alias("component"))
    of = cut(of)
    for held in reversed(runs):  # a run is part of what its ends are both part of
        ends = held.join(of.select(F.col("node").alias("top"), F.col("component").alias("up")), "top", "left").join(of.select(F.col("node").alias("bottom"), F.col("component").alias("down")), "bottom", "left")
        inside = ends.select("node", F.coalesce("ring", F.when(F.col("up") == F.col("down"), F.col("up"))).alias("inside"))
        of = cut(of.join(inside, "node", "left").select("node", F.coalesce("inside", "component").alias("component")))
    least = of.groupBy("component").agg(F.min("node").alias("least"))
    return of.join(least, "component").select("node", F.col("least").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes of edges (a, b), any number of them each way, that lie on a cycle."""
    of = cut(strong_components(edges))
    many = of.groupBy("component").count().where("count > 1").select("component")
    return of.join(many, "component", "left_semi").select("node").union(edges.where("a = b").select(F.col("a").cast("bigint"))).distinct()


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer) of a graph with edges (a before b) of any number: 0 for nodes with nothing before them, else one more than the latest before them.

    Nodes on a cycle or behind one have no layer and are left out. Runs of nodes with one edge in and one out are compressed by
    doubling first; then a round settles the nodes all of whose edges come from settled ones, so rounds grow with the longest
    chain of what is left.
    """
    plain = cut(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a != b").distinct().withColumn("w", F.lit(1).cast("bigint")))
    left, held = _compressed(plain)
    left = cut(left.withColumn("at", F.lit(None).cast("bigint")))
    ends = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    free = cut(ends.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(0).cast("bigint")))
    done, k = free, 0
    while not free.isEmpty():
        k += 1
        told = left.join(free.select(F.col("node").alias("a"), "layer"), "a", "left").select("a", "b", "w", F.coalesce("at", F.col("layer") + F.col("w")).alias("at"))
        left = cut(told)
        free = cut(left.groupBy(F.col("b").alias("node")).agg(F.max("at").alias("layer"), F.count_if(F.col("at").isNull()).alias("open")).where("open = 0").drop("open"))
        left = left.join(free.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b", "w", "at")
        done = done.unionByName(free)
        if k % 16 == 0:
            done = cut(done)
    done = cut(done)
    inner = held.where("ring is null").join(done.select(F.col("node").alias("top"), F.col("layer").alias("up")), "top").select("node", (F.col("up") + F.col("steps")).alias("layer"))
    return done.unionByName(inner).select("node", F.col("layer").cast("int").alias("layer"))


def order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer, place, drain): an order in which every node comes after all that lead to it, ties by number; and the reverse order, from 1.

    ``nodes`` holds every node, those without edges too. Nodes on a cycle or behind one are left out. Places are
    counted in ranges of (layer, node), so no task holds a layer.
    """
    ranked = layers(edges)
    alone = nodes.select(F.col("node").cast("bigint").alias("node")).distinct().join(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")
    # an edge to itself is a cycle; behind one nothing is settled
    looped = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    if not looped.isEmpty():
        far = _grown(looped, lambda fresh: edges.where("a != b").join(fresh.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct(), lambda now, more: now.withColumn("new", F.lit(False)).unionByName(more.join(now, "node", "left_anti").withColumn("new", F.lit(True))))
        ranked = ranked.join(far, "node", "left_anti")
    rows = ranked.unionByName(alone.withColumn("layer", F.lit(0)))

    def count(parts):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for p in parts:
            yield p.assign(task=task, nth=range(n + 1, n + len(p) + 1))
            n += len(p)

    numbered = cut(rows.repartitionByRange("layer", "node").sortWithinPartitions("layer", "node").mapInPandas(count, "node bigint, layer int, task int, nth bigint"))
    sizes = numbered.groupBy("task").agg(F.max("nth").alias("n"))  # a row for each task
    before = sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return numbered.join(F.broadcast(before), "task").select("node", "layer", (F.col("ahead") + F.col("nth")).alias("place"), (F.col("all") - F.col("ahead") - F.col("nth") + 1).alias("drain"))
