"""Scans: walks over paths, history records, line windows, encodings, timings, and logs that are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import encodings, paths
from quern.operators import batches
from quern.operators.lineage import cut, drop, shared_folder
from quern.plans.registry import query
from quern.sources import folders, jsonl, vector_store
from quern.sources.tables import table

# Documents as files: a path made of source, number and one of some endings.
ENDINGS = ["/main.py", "/notes.md", "/app.min.js", "/package-lock.json", "/.env/x.go", "/src/node_modules/a.ts", "/gen/types.generated.ts", "/index.html", "/draft/plan.md", "/data.bin"]
IGNORED = ["draft/", "/src3/**/*.html"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), ending).alias("path"), "text")


FILES_SQL = f"files AS (SELECT doc_id, source || '/d' || doc_id || {ENDINGS!r}[doc_id % {len(ENDINGS)} + 1] AS path, text FROM documents)"
_WALKED_SQL = rf"(NOT regexp_matches(path, '(^|/)\.[^/]') AND NOT regexp_matches(path, '(^|/)({'|'.join(paths.SKIPPED_DIRS)})/') AND NOT regexp_matches(path, '^(.*/)?draft/.*$') AND NOT regexp_matches(path, '^src3/(.*/)?[^/]*\.html(/.*)?$'))"
_NAME_SQL = "lower(regexp_extract(path, '([^/]*)$', 1))"
_INDEXABLE_SQL = f"(strlen(text) BETWEEN 1 AND {paths.MAX_SIZE} AND list_contains({paths.EXTENSIONS!r}, regexp_extract({_NAME_SQL}, '(\\.[^.]*)$', 1)) AND NOT list_contains({paths.GENERATED_NAMES!r}, {_NAME_SQL}) AND NOT ({' OR '.join(f'ends_with({_NAME_SQL}, {s!r})' for s in paths.GENERATED_SUFFIXES)}))"


@query("s04_workspace_scan", f"WITH {FILES_SQL} SELECT path FROM files WHERE {_WALKED_SQL} AND {_INDEXABLE_SQL}")
def workspace_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a walk reaches (no hidden, skipped or ignored ones) and that are worth indexing."""
    f = files(spark, sf_dir)
    return f.where(paths.walked(F.col("path"), IGNORED) & paths.indexable(F.col("path"), F.octet_length("text"))).select("path")


@query(
    "s04_folder_scan",
    "SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND lang <> 'de' AND NOT (lang = 'fr' AND source LIKE '%1') AND source NOT LIKE '%3'",
)
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents, written into folders by language and source, and read from those folders that the rules leave."""
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    docs.select(F.col("doc_id").cast("string").alias("value"), "lang", "source").write.partitionBy("lang", "source").text(path)
    rules = "/lang=de/\n*.crc\nlang=fr/source=*1\nsource=*[3]/\n_SUCCESS\n"
    found = folders.read(spark, path, content=True, rules=rules).where("size > 0").select("path", F.explode(F.split(F.rtrim(F.col("content").cast("string"), F.lit("\n")), "\n")).alias("id"))
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)", 1).alias(name)
    rows = cut(found.select(F.col("id").cast("bigint").alias("doc_id"), part("lang"), part("source")))
    drop(spark, path)
    return rows


@query("s05_indexable", f"WITH {FILES_SQL} SELECT doc_id, {_INDEXABLE_SQL} AS by_name, strlen(text) // len(string_split(text, chr(10))) <= {paths.MEAN_LINE} AND list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) <= {paths.MAX_LINE} AS by_content FROM files")
def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file is worth indexing: size, ending, generated names; mean and longest line in bytes."""
    return files(spark, sf_dir).select("doc_id", paths.indexable(F.col("path"), F.octet_length("text")).alias("by_name"), paths.written_by_hand(F.col("text")).alias("by_content"))


_RECORD_SQL = """record AS (SELECT doc_id, doc_id || chr(31) || '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || chr(31) || source || chr(31) || string_split(text, chr(10))[1] || CASE WHEN doc_id % 13 = 0 THEN '' ELSE chr(31) || array_to_string(string_split(text, chr(10))[2:4], chr(10)) END AS raw, text FROM documents),
history AS (SELECT doc_id, string_split(raw, chr(31)) AS f, text FROM record WHERE len(string_split(raw, chr(31))) = 5)"""
DIFF_BYTES = 4000


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of a history: five fields parted by a control character; every thirteenth lacks one."""
    line = F.split("text", "\n", -1)
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    body = F.when(F.col("doc_id") % 13 != 0, F.array_join(F.slice(line, 2, 3), "\n"))  # concat_ws leaves a null out
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\x1f", F.col("doc_id").cast("string"), date, "source", line[0], body).alias("raw"), "text")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hash, date, author, subject, body, files, diff) of records that have all fields; a diff is cut at DIFF_BYTES bytes."""
    f = records(spark, sf_dir).withColumn("f", F.split("raw", "\x1f", 5)).where(F.size("f") == 5)
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z]+\.[a-z]+"), F.lit(0)))
    return f.select(F.col("f")[0].alias("hash"), F.col("f")[1].alias("date"), F.col("f")[2].alias("author"), F.trim(F.col("f")[3]).alias("subject"), F.trim(F.col("f")[4]).alias("body"), named.alias("files"), F.substring(F.col("text").cast("binary"), 1, DIFF_BYTES).alias("diff"), "text")


@query("s06_history_fields", f"WITH {_RECORD_SQL} SELECT f[1] AS hash, f[2] AS date, f[3] AS author, trim(f[4]) AS subject, sha256(trim(f[5])) AS body, len(list_distinct(regexp_extract_all(text, '[a-z]+\\.[a-z]+'))) AS files, sha256(unhex(left(hex(encode(text)), {2 * DIFF_BYTES}))) AS diff FROM history")
def history_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a history with the files that they name and the beginning of their diffs; records that lack a field are passed over."""
    return history(spark, sf_dir).select("hash", "date", "author", "subject", F.sha2("body", 256).alias("body"), F.size("files").cast("bigint").alias("files"), F.sha2("diff", 256).alias("diff"))


@query("s07_sessions", "WITH s AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id) SELECT conv_id, turns, last_turn, row_number() OVER (ORDER BY last_turn DESC, conv_id) AS place FROM s WHERE turns > 0 ORDER BY place LIMIT 1000")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have a turn, the last active first; a page of a thousand."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.max("turn").alias("last_turn")).where("turns > 0")
    page = s.orderBy(F.desc("last_turn"), "conv_id").limit(1000)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_turn"), "conv_id"))).orderBy("place")  # over one page


@query(
    "s12_tree",
    f"WITH {FILES_SQL}, seg AS (SELECT path, strlen(text) AS size, string_split(path, '/') AS p FROM files WHERE NOT regexp_matches(path, '(^|/)({'|'.join(paths.SKIPPED_DIRS)})/')), up AS (SELECT array_to_string(p[1:k], '/') AS folder, k AS depth, size FROM (SELECT p, size, unnest(range(1, least(len(p), 50))) AS k FROM seg)) SELECT folder, depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM up GROUP BY ALL",
)
def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive listing: files and bytes below each folder, fifty levels deep, without folders of noise."""
    dirs = "|".join(paths.SKIPPED_DIRS)
    seg = files(spark, sf_dir).where(~F.col("path").rlike(f"(?:^|/)(?:{dirs})/")).select(F.split("path", "/").alias("p"), F.octet_length("text").alias("size"))
    depth = F.sequence(F.lit(1), F.least(F.size("p"), F.lit(50)) - 1)
    up = seg.where("size(p) > 1").select(F.explode(F.transform(depth, lambda k: F.struct(F.array_join(F.slice("p", F.lit(1), k), "/").alias("folder"), k.alias("depth")))).alias("x"), "size")
    return up.groupBy("x.folder", "x.depth").agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))


@query("s14_line_window", "SELECT doc_id, i + 1 AS line_no, s, n > 5 AS has_more FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE i >= 2 AND i < 5")
def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of each text from an offset on, and whether there are more."""
    return read_window(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 3)


def read_window(docs: DataFrame, key: str, text: str, offset: int = 0, limit: int = 2000) -> DataFrame:
    """(key, line_no, s, has_more): ``limit`` lines from the 0-based ``offset`` on, numbered from 1."""
    line = docs.select(key, F.split(text, "\n", -1).alias("l")).where(F.size("l") > offset)
    part = line.select(key, F.posexplode(F.slice("l", offset + 1, limit)).alias("i", "s"), (F.size("l") > offset + limit).alias("has_more"))
    return part.select(key, (F.col("i") + offset + 1).alias("line_no"), "s", "has_more")


_CODECS = ["utf-8", "utf-16-le", "utf-16-be", "gb18030", "utf-8-sig"]


@query(
    "s15_decode",
    "SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'binary' WHEN doc_id % 6 = 1 THEN 'utf-16le' WHEN doc_id % 6 = 2 THEN 'utf-16be' WHEN doc_id % 6 = 4 THEN 'utf-8-bom' WHEN doc_id % 6 = 3 AND regexp_matches(text, '[^\\x00-\\x7F]') THEN 'gb18030' ELSE 'utf-8' END AS kind, CASE WHEN doc_id % 6 <> 5 THEN sha256(text) END AS digest FROM documents",
)
def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in several encodings, told apart and read as the text that they came from; bytes with a zero are binary."""
    batches.bounded(spark)
    d = table(spark, sf_dir, "documents")
    codec = F.element_at(F.array(*map(F.lit, [*_CODECS, "utf-8"])), (F.col("doc_id") % 6 + 1).cast("int"))
    mark = F.when(F.col("doc_id") % 6 == 1, F.unhex(F.lit("FFFE"))).when(F.col("doc_id") % 6 == 2, F.unhex(F.lit("FEFF"))).otherwise(F.lit(b""))
    zero = F.when(F.col("doc_id") % 6 == 5, F.lit(b"\0")).otherwise(F.lit(b""))
    data = d.select("doc_id", F.concat(mark, zero, encodings.encoded(F.col("text"), codec)).alias("data"))
    return data.select("doc_id", encodings.decoded(F.col("data")).alias("x")).select("doc_id", "x.kind", F.sha2("x.text", 256).alias("digest"))


@query("s15_binary_skip", "SELECT doc_id, NOT contains(text, chr(0)) AS is_text FROM documents")
def binary_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold no zero byte."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.instr("text", F.char(F.lit(0))) == 0).alias("is_text"))


@query("s18_arm_union", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END AS arm, o_orderkey AS task, o_orderstatus = 'F' AS passed FROM orders")
def arm_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON result set of each arm, written and read again, as one table with the name of its arm."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_orderstatus") == "F").alias("passed"))
    base = f"{shared_folder(spark)}/arms-{uuid.uuid4().hex}"
    arms = {"finished": f"{base}/a", "open": f"{base}/b"}
    for passed, path in zip((True, False), arms.values(), strict=True):
        o.where(F.col("passed") == passed).write.json(path)
    return jsonl.read_arms(spark, arms, "task bigint, passed boolean").select("arm", "task", "passed")


@query("s20_slowest", "SELECT event_id AS test, value AS seconds FROM events WHERE event_type IN ('view', 'purchase') ORDER BY value DESC, event_id LIMIT 15")
def slowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest tests of a log of JSON lines: only records that end a test count, and lines of other kinds are passed over."""
    action = F.when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "purchase", "fail").otherwise("output")
    record = F.to_json(F.struct(action.alias("Action"), F.col("event_id").alias("Test"), F.col("value").alias("Elapsed"), F.col("props").alias("Output")))
    line = table(spark, sf_dir, "events").select(F.explode(F.array(record, F.concat(F.lit("# run "), F.col("event_id").cast("string")))).alias("line"))
    r = line.where(F.col("line").startswith("{")).select(F.from_json("line", "Action string, Test bigint, Elapsed double").alias("r")).select("r.*")
    return r.where(F.col("Action").isin("pass", "fail") & F.col("Test").isNotNull()).orderBy(F.desc("Elapsed"), "Test").limit(15).select(F.col("Test").alias("test"), F.col("Elapsed").alias("seconds"))


@query(
    "s22_project_index",
    "WITH e AS (SELECT lower(trim(n_name)) AS key, 1 AS src, s_name AS title, '' AS owner, s_acctbal AS activity FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT lower(trim(n_name)), 2, '', c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT key, coalesce(min(nullif(title, '')), '') AS title, coalesce(min(nullif(owner, '')), '') AS owner, max(activity) AS activity, count(*) AS entries, min(src) AS src FROM e GROUP BY key) SELECT key, title, owner, activity, entries FROM m WHERE contains(key, 'a') OR contains(lower(title), 'a1')",
)
def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of several sources as one for each key in its canonical form, each field from where it is not empty; then those that a word selects."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.trim("n_name")).alias("key"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("title"), F.lit("").alias("owner"), F.col("s_acctbal").alias("activity"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.lit("").alias("title"), F.col("c_name").alias("owner"), F.col("c_acctbal").alias("activity"))
    e = s.unionByName(c).join(F.broadcast(n), "n_nationkey")
    one = lambda f: F.coalesce(F.min(F.nullif(F.col(f), F.lit(""))), F.lit("")).alias(f)
    m = e.groupBy("key").agg(one("title"), one("owner"), F.max("activity").alias("activity"), F.count("*").alias("entries"))
    return m.where(F.contains("key", F.lit("a")) | F.contains(F.lower("title"), F.lit("a1")))


@query("s08_source_union", "WITH u AS (SELECT conv_id AS id, 1 AS scope FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, 2 FROM conversations) SELECT id, min(scope) AS scope FROM u GROUP BY id")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several sources as one, each item once, under its first scope."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role")
    u = c.where("role = 'system'").select("id", F.lit(1).alias("scope")).unionByName(c.select("id", F.lit(2).alias("scope")))
    return u.groupBy("id").agg(F.min("scope").alias("scope"))


@query("s03_append_read", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def append_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log by day that is appended to twice and read for three days; other folders are not opened."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    for half in ("ts < timestamp_ntz '2024-01-06 12:00:00'", "ts >= timestamp_ntz '2024-01-06 12:00:00'"):
        jsonl.append_days(e.where(half), path)
    return jsonl.read_days(spark, path, "event_id bigint, user_id bigint, ts string", "2024-01-05", "2024-01-07").select("event_id", "user_id")


@query("s17_log_until_damage", "WITH m AS (SELECT CAST(avg(event_id) AS BIGINT) AS bad FROM events) SELECT event_id, event_type FROM events, m WHERE event_id < bad")
def log_until_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict log of JSON lines up to its first damaged one."""
    e = table(spark, sf_dir, "events")
    bad = e.agg(F.round(F.avg("event_id")).cast("bigint").alias("bad"))
    raw = F.to_json(F.struct("event_id", "event_type", F.col("value").alias("unread")))
    line = e.join(F.broadcast(bad)).select("event_id", F.when(F.col("event_id") == F.col("bad"), F.left(raw, F.lit(9))).otherwise(raw).alias("raw")).withColumnRenamed("event_id", "seq")
    return jsonl.until_damage(line, "seq", "raw", "event_id bigint, event_type string").select("record.event_id", "record.event_type")


@query("s09_vector_store", "SELECT label % 4 AS path, count(*) AS chunks FROM embeddings WHERE label % 4 <> 3 GROUP BY 1")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written by path; two paths are written again, one is deleted, and vectors of another recipe are as good as absent."""
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("path"), "vec_id", F.col("embedding").alias("vec"))
    base, made_by = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", vector_store.recipe(1, "given", 64)
    vector_store.write(e, base, made_by)
    vector_store.write(e.where("path < 2"), base, made_by)
    vector_store.write(e.where("path = 0").withColumn("path", F.lit(9)), base, vector_store.recipe(0, "older", 64))
    vector_store.delete(spark, base, 3)
    return vector_store.read(spark, base, made_by, 64).groupBy(F.col("path").cast("int").alias("path")).agg(F.count("*").alias("chunks"))


