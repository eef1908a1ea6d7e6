"""Full-text ranking: BM25 over exploded terms, and a floor relative to the best score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import CJK, tokens
from quern.operators.lineage import cut

K1, B = 1.2, 0.75


def query_terms(query: str, spark) -> list[str]:
    """Distinct terms of a query in their order."""
    terms = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()["t"]
    if not terms:
        raise ValueError("the query has no terms")
    return terms


def bm25(docs: DataFrame, terms: list[str], id_col: str, text: Column, terms_too: bool = False) -> DataFrame:
    """(id, score, matched) of documents that hold a term, with ``terms_too`` also which.

    Only occurrences of query terms leave the scan, counted inside each document; the
    corpus statistics are one row, which is broadcast.
    """
    # Texts are read and cut into tokens once; the narrow table of lengths and hits is read for the statistics and the scores.
    own = docs.select(F.col(id_col), tokens(text).alias("toks"))
    counted = cut(own.select(id_col, F.size("toks").alias("len"), F.filter("toks", lambda t: t.isin(terms)).alias("hits")))
    stats = counted.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("len"), F.lit(1e-9)).alias("avg_len"))
    hit = counted.where(F.size("hits") > 0).select(id_col, "len", F.explode(F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda x: x == t)).alias("tf")))).alias("h")).select(id_col, "len", "h.term", "h.tf")
    return _scored(hit, stats, id_col, terms_too)


def _scored(hit: DataFrame, stats: DataFrame, id_col: str, terms_too: bool) -> DataFrame:
    """Scores from (id, len, term, tf) of the query's terms and one row of statistics."""
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # at most one row for each query term
    scored = hit.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    # Added up in the order of terms, so that the sum is the same in every run.
    parts = F.transform(F.array_sort(F.collect_list(F.struct("term", (idf * tf).alias("s")))), lambda p: p["s"])
    return scored.groupBy(id_col).agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"), F.count("*").alias("matched"), *([F.array_sort(F.collect_set("term")).alias("terms")] if terms_too else []))


BUCKETS = 32


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_postings(docs: DataFrame, id_col: str, text: Column, path: str) -> None:
    """Writes an index of ``docs``: a row for each document and term, in folders by a hash of the term, and the corpus statistics.

    Texts are cut into tokens once, and terms are counted inside each document, so one shuffle brings the rows to their folders. The
    statistics are added up from what is written.
    """
    own = docs.select(F.col(id_col).alias("id"), F.sort_array(tokens(text)).alias("t"))
    starts = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (F.get("t", i - 1) != x), i)), lambda x: x.isNotNull())
    runs = own.select("id", "t", starts.alias("at")).select("id", F.size("t").alias("len"), F.explode(F.transform("at", lambda a, i: F.struct(F.get("t", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.size("t")) - a).alias("tf")))).alias("x"))
    rows = runs.select(_bucket(F.col("x.term")).alias("bucket"), "x.term", "id", "len", "x.tf")
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    total = docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/postings").agg(F.sum("tf").alias("total"))
    lengths = docs.agg(F.count("*").alias("n_docs"), F.count(text).alias("texts")).join(F.broadcast(total))
    lengths.select("n_docs", F.greatest(F.try_divide("total", "texts"), F.lit(1e-9)).alias("avg_len")).write.mode("overwrite").parquet(f"{path}/stats")


def search_postings(spark, path: str, terms: list[str]) -> DataFrame:
    """(id, score, matched) as :func:`bm25`, from an index: only the folders of the terms are opened, and sorted files let row groups be passed over."""
    wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).collect()})
    hit = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    return _scored(hit, spark.read.parquet(f"{path}/stats"), "id", False)


# Answers that ask for nothing.
GENERIC = ["continue", "please continue", "go on", "next", "ok", "okay", "yes", "no", "继续", "好的", "好", "是", "否", "下一步"]


def is_generic(query: str) -> bool:
    """Whether a query only tells to go on."""
    return " ".join(query.split()).lower() in GENERIC


def distinctive(query: str, term: str) -> bool:
    """Whether a term stands in the query in a form that hardly occurs by chance: with a digit, an underscore or a capital inside, after ``#``, or before a full stop."""
    for word in query.split():
        bare = word.strip("#()[]{}<>,;:'\"`!?=+*/\\|")
        if bare.lower() == term and (any(c.isdigit() for c in bare) or "_" in bare or any(c.isupper() for c in bare[1:])):
            return True
    return f"#{term}" in query or f"{term}." in query


def strong_match(query: str, terms: list[str], matched: Column) -> Column:
    """Whether the matched terms are enough to recall something: two of them (three, if all are single CJK characters), or one that is long in a short query, or distinctive."""
    alone = [t for t in terms if (len(terms) <= 2 and len(t) >= 6) or distinctive(query, t)]
    several = (F.size(matched) >= 2) & (F.exists(matched, lambda t: ~t.rlike(rf"^[{CJK}]$")) | (F.size(matched) >= 3))
    return several | ((F.size(matched) == 1) & matched[0].isin(alone))


def floor(scored: DataFrame, ratio: float, score: str = "score") -> DataFrame:
    """Rows with at least ``ratio`` of the best score. The best is one row, and no window gathers all rows in a task."""
    best = scored.agg(F.max(score).alias("best_score"))
    return scored.join(F.broadcast(best)).where((F.lit(ratio) <= 0) | (F.col("best_score") <= 0) | (F.col(score) >= ratio * F.col("best_score"))).drop("best_score")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def boosted(score: Column, terms: list[str], heading: Column, phrase: Column, same_language: Column, same_release: Column) -> Column:
    """BM25 of a section with what speaks for it besides: each query term in its headings, the phrase in its text, its language, and the release that was asked for by number."""
    hits = F.size(F.array_intersect(F.array(*map(F.lit, terms)), heading))
    total = score + F.when(same_release, 100.0).otherwise(0.0) + 0.35 * hits + F.when(phrase, 1.5).otherwise(0.0)
    return total * F.when(same_language, 1.15).otherwise(1.0)
