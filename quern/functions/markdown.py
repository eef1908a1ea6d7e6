"""Sections of Markdown texts: by headings of four levels, each with the trail of headings above it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4
#: An ATX heading: up to three spaces, one to four hashes, a space, and its text without closing hashes.
HEADING = r"^ {0,3}(#{1,4})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$"
FENCE = r"^ {0,3}(?:```|~~~)"


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, level, heading, trail, title, start_line, end_line, content) of each section that is not blank.

    Lines inside fences are never headings. What stands before the first heading is a section of level 0
    whose trail is the title: the first heading of level one, or empty.
    """
    line = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "s"))
    w = Window.partitionBy(key).orderBy("i")
    fence = F.col("s").rlike(FENCE)
    line = line.withColumn("open", F.sum(fence.cast("int")).over(w) % 2 == 1).withColumn("free", ~F.col("open") & ~fence)
    head = F.when(F.col("free") & F.col("s").rlike(HEADING) & (F.trim(F.regexp_extract("s", HEADING, 2)) != ""), F.trim(F.regexp_extract("s", HEADING, 2)))
    line = line.withColumn("heading", head).withColumn("level", F.when(F.col("heading").isNotNull(), F.length(F.regexp_extract("s", HEADING, 1))))
    # The last heading of each level, with its line; it stands in the trail unless a higher one came after it.
    last = [F.last(F.when(F.col("level") == k, F.struct("i", "heading")), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)]
    line = line.withColumn("section", F.count("heading").over(w)).withColumn("last", F.array(*last))
    first = F.min_by("heading", F.when(F.col("level") == 1, F.col("i")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "\n")
    out = line.groupBy(key, "section").agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.max("heading").alias("heading"), F.min_by("last", "i").alias("last"), (F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), F.trim(body).alias("content"), first.alias("h1"), F.min(F.when(F.col("level") == 1, F.col("i"))).alias("h1_at"),
    )
    out = out.withColumn("title", F.coalesce(F.min_by("h1", "h1_at").over(Window.partitionBy(key)), F.lit("")))
    stands = lambda x, k: x.isNotNull() & F.forall(F.slice("last", 1, k), lambda y: y.isNull() | (y["i"] <= x["i"]))
    trail = F.array_compact(F.array(*(F.when(stands(F.col("last")[k], k + 1), F.col("last")[k]["heading"]) for k in range(LEVELS))))
    trail = F.when(F.col("level") == 0, F.col("title")).otherwise(F.array_join(trail, " > "))
    return out.where(F.col("content").rlike(r"\S")).select(key, "section", "level", "heading", trail.alias("trail"), "title", "start_line", "end_line", "content")
