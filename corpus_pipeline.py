"""A corpus pipeline of five stages, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents, and no others; the last returns what the tokeniser made of each text.
An empty table goes through every stage and stays empty. Rows with null or empty texts, and texts of any
length, are handled like all others; so are nulls in any other column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, exchange, jaccard, pieces, privacy, queries, toxicity
from quern.llm.store import materialise, shared_folder
from quern.operators.lineage import drop

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go. Texts are scored where they lie, and not shuffled.

    Null and empty texts match no clause and stay; repeated rows go or stay together.
    """
    return toxicity.clean(docs.select(COLUMNS), queries.table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays; of repeated rows, one.

    Null and empty texts are similar to nothing and stay, but repeated rows of an id and text become one. Rows without a
    doc_id all stay. Rows of one doc_id with different texts stay if that id is the smallest of its component.
    Only texts of documents that may go are shuffled.
    """
    queries.small_batches(spark)
    components = materialise(jaccard.join(docs, links=False))
    doubtful = components.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("component_id") != F.col("doc_id")).alias("copy")).where("rows > 1 or copy")
    rows = exchange.parted(docs, doubtful.select("doc_id"))
    kept = components.where("component_id = doc_id").select("doc_id").distinct()
    others = rows(True).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows(False).select(COLUMNS).unionByName(others.select(COLUMNS))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; the texts of the others stay where they lie."""
    found = materialise(decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark")).select("doc_id", (F.size("item_ids") > 0).alias("hit")))
    hit = found.where("hit and doc_id is not null").select("doc_id").distinct()
    rows = exchange.parted(docs, hit)
    return rows(False).select(COLUMNS).unionByName(rows(True).join(hit, "doc_id", "left_anti").select(COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars is counted anew, null for null texts. No row goes."""
    changed = privacy.pseudonymise(docs, queries.secret_key(spark))
    return changed.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text with their byte spans; null and empty texts have none. No row goes."""
    queries.small_batches(spark)
    return pieces.encode(docs, queries.PIECES, texts=False)


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard", near_copies),
    ("decontamination", contaminated),
    ("pii", private),
    ("sentencepiece", encoded),
]

#: Scores, surrogates and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; what the next one has read is deleted, and the last result stays.

    Of repeated rows one stays after the second stage; the other stages handle rows that are alike alike, so ties need no order.
    """
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if done:
            drop(spark, done)
        docs, done = spark.read.parquet(path), path
    return docs
