"""Writes: tables that are upserted, purged, rolled up and kept in step, and what a reader finds afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.versioned import BucketTable, RollUp, VersionedTable, sync
from quern.plans.registry import query
from quern.sources.tables import AS_OF_SQL, PINGS_SQL, USERS_SQL, events, metric_users, pings, table, with_as_of

_CUT = "timestamp_ntz '2024-01-20'"


@query("d01_upsert_increment", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def upsert_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a batch adds to, in a table that is written twice."""
    e = table(spark, sf_dir, "events")
    count = lambda d: d.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return VersionedTable(spark).replace(count(e.where(f"ts < {_CUT}"))).upsert_add(count(e.where(f"ts >= {_CUT}")), ["event_type", "user_id"], "n").read()


@query("d02_upsert_replace", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that keeps the last write for each key; the later batch is merged into what the earlier one left."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    t = VersionedTable(spark).replace(e.limit(0)).upsert_last(e.where(f"ts < {_CUT}"), keys, order).upsert_last(e.where(f"ts >= {_CUT}"), keys, order)
    return t.read().select("user_id", "event_type", "value")


_SEVERITY_SQL = "CASE WHEN value > 90 THEN 'critical' WHEN value > 30 THEN 'high' WHEN value < 3 THEN 'low' ELSE 'medium' END"


@query(
    "d03_crash_groups",
    f"""WITH e AS (SELECT user_id % 20 AS fp, event_id, ts, event_type, 'v1.' || (event_id % 5) AS version, {_SEVERITY_SQL} AS severity, lag(event_type) OVER w AS prev, row_number() OVER w AS k
  FROM events WHERE event_type IN ('error', 'purchase') WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts, event_id) AS nth FROM e WHERE event_type = 'error'),
s AS (SELECT fp, arg_max(CASE WHEN event_type = 'purchase' THEN 'resolved' ELSE 'open' END, struct_pack(a := ts, b := event_id)) AS status FROM e GROUP BY fp)
SELECT r.fp, count(*) AS n, arg_min(version, struct_pack(a := ts, b := event_id)) AS first_version, arg_max(version, struct_pack(a := ts, b := event_id)) AS last_version, any_value(status) AS status,
  CASE WHEN max(CASE WHEN nth = 1 THEN severity END) <> 'critical' AND bool_or(severity = 'low') THEN 'low' ELSE max(CASE WHEN nth = 1 THEN severity END) END AS severity,
  max(CASE WHEN prev = 'purchase' THEN event_id END) AS regressed_by FROM r JOIN s ON r.fp = s.fp GROUP BY r.fp""",
)
def crash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: groups of reports as a state that each report changes, in the order of arrival.

    A group is opened by its first report; a fix (``purchase``) resolves it, and the next report opens it again and
    is noted as the regression. A severity that began as critical stays; else a low report makes it low, and no other changes it.
    What the steps leave depends on the first report, on whether a low one came, and on the neighbour before each: no fold is needed.
    """
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).withColumn("fp", F.col("user_id") % 20).withColumn("version", F.concat(F.lit("v1."), F.col("event_id") % 5))
    severity = F.when(F.col("value") > 90, "critical").when(F.col("value") > 30, "high").when(F.col("value") < 3, "low").otherwise("medium")
    e = e.withColumn("severity", severity).withColumn("prev", F.lag("event_type").over(Window.partitionBy("fp").orderBy("ts", "event_id")))
    order, report = F.struct("ts", "event_id"), F.col("event_type") == "error"
    g = e.groupBy("fp").agg(
        F.count_if(report).alias("n"), F.min_by("version", F.when(report, order)).alias("first_version"), F.max_by("version", F.when(report, order)).alias("last_version"), F.min_by("severity", F.when(report, order)).alias("first"),
        F.when(F.max_by("event_type", order) == "purchase", "resolved").otherwise("open").alias("status"), F.bool_or(report & (F.col("severity") == "low")).alias("low"),
        F.max(F.when(report & (F.col("prev") == "purchase"), F.col("event_id"))).alias("regressed_by"),
    )
    final = F.when((F.col("first") != "critical") & F.col("low"), "low").otherwise(F.col("first"))
    return g.where("n > 0").select("fp", "n", "first_version", "last_version", "status", final.alias("severity"), "regressed_by")


@query(
    "d04_immutable_insert",
    """WITH have AS (SELECT p_brand AS package, p_size AS patch, min(p_partkey) AS made_by FROM part GROUP BY ALL), last AS (SELECT package, max(patch) AS top FROM have GROUP BY package),
asked AS (SELECT s_suppkey AS id, 'Brand#' || (s_suppkey % 25 + 1) AS package, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey + 40 END AS patch FROM supplier),
best AS (SELECT id, a.package, coalesce(a.patch, top + 1, 1) AS patch, a.patch IS NULL AS bumped FROM asked a LEFT JOIN last USING (package)),
f AS (SELECT *, row_number() OVER (PARTITION BY package, patch ORDER BY id) AS k FROM best)
SELECT f.id, f.package, f.patch, CASE WHEN have.patch IS NOT NULL OR k > 1 THEN 'conflict' WHEN bumped THEN 'bumped' ELSE 'inserted' END AS outcome FROM f LEFT JOIN have ON f.package = have.package AND f.patch = have.patch""",
)
def immutable_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions are only ever added: one that is there, or asked for twice, is a conflict; one without a number gets the next patch."""
    have = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_size").alias("patch")).distinct()
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("package"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") + 40).alias("want"))
    best = asked.join(have.groupBy("package").agg(F.max("patch").alias("top")), "package", "left").withColumn("patch", F.coalesce("want", F.col("top") + 1, F.lit(1)))
    first = F.row_number().over(Window.partitionBy("package", "patch").orderBy("id"))
    f = best.withColumn("k", first).join(have.withColumn("there", F.lit(True)), ["package", "patch"], "left")
    outcome = F.when(F.col("there") | (F.col("k") > 1), "conflict").when(F.col("want").isNull(), "bumped").otherwise("inserted")
    return f.select("id", "package", "patch", outcome.alias("outcome"))


@query(
    "d04_inserted_versions",
    """WITH have AS (SELECT p_brand AS package, p_size AS patch, min(p_partkey) AS made_by FROM part GROUP BY ALL), last AS (SELECT package, max(patch) AS top FROM have GROUP BY package),
asked AS (SELECT s_suppkey AS id, 'Brand#' || (s_suppkey % 25 + 1) AS package, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey + 40 END AS patch FROM supplier),
best AS (SELECT id, a.package, coalesce(a.patch, top + 1, 1) AS patch FROM asked a LEFT JOIN last USING (package))
SELECT package, patch, made_by FROM have UNION ALL SELECT package, patch, min(id) FROM best WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.package = best.package AND h.patch = best.patch) GROUP BY package, patch""",
)
def inserted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of versions after the inserts: those that were there are as they were, and of several that ask for one, the first has it; a second run of the same inserts changes nothing."""
    have = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package"), F.col("p_size").cast("bigint").alias("patch")).agg(F.min("p_partkey").alias("made_by"))
    store = VersionedTable(spark).replace(have)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("package"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey") + 40).alias("want"))
    top = store.read().groupBy("package").agg(F.max("patch").alias("top"))
    new = asked.join(top, "package", "left").groupBy("package", F.coalesce("want", F.col("top") + 1, F.lit(1)).alias("patch")).agg(F.min("id").alias("made_by"))
    return store.insert_new(new, ["package", "patch"]).insert_new(new, ["package", "patch"]).read()


@query("u06_kept_versions", "SELECT s_suppkey, s_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0) UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table to which only rows with new keys are added; those that are there stay as they are."""
    have = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return VersionedTable(spark).replace(have).insert_new(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"]).read()


_STEP_SQL = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


def floored(total, least_prefix):
    """Where a counter ends that stops at 0 at every step, from the sum of its steps and the least sum of its first ones."""
    return total - F.least(F.lit(0), least_prefix)


@query("d05_counter_floor", f"WITH r AS (SELECT user_id, sum({_STEP_SQL}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, {_STEP_SQL} AS d FROM events) SELECT user_id, CAST(sum(d) - least(0, min(s)) AS BIGINT) AS stars FROM r GROUP BY user_id")
def counter_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that stops at 0 at every step, so that a step down from 0 is lost."""
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    r = table(spark, sf_dir, "events").withColumn("d", step).withColumn("s", F.sum("d").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return r.groupBy("user_id").agg(floored(F.sum("d"), F.min("s")).alias("stars"))


@query(
    "d08_retention_purge",
    f"WITH {PINGS_SQL}, {USERS_SQL}, {AS_OF_SQL} SELECT 'pings' AS log, date, count(*) AS left_rows FROM pings, as_of WHERE date > d - 10 GROUP BY date UNION ALL SELECT 'metric_users', date, count(*) FROM metric_users, as_of WHERE date > d - 20 GROUP BY date",
    dates=("date",),
)
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that keep different numbers of days; a purge writes what is left, and days that are gone whole are never read."""
    left = lambda rows, days: VersionedTable(spark).replace(rows).change(lambda old: with_as_of(old, spark, sf_dir).where(F.col("date") > F.date_sub("as_of", days)).drop("as_of")).read().groupBy("date").agg(F.count("*").alias("left_rows"))
    a, b = left(pings(spark, sf_dir), 10), left(metric_users(spark, sf_dir), 20)
    return a.select(F.lit("pings").alias("log"), "date", "left_rows").unionByName(b.select(F.lit("metric_users").alias("log"), "date", "left_rows"))


@query("d10_additive_schema", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, n_name AS country FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT s_suppkey, s_name, '', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def additive_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table read with the columns that came later, and a new column filled from data that is there."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    t = VersionedTable(spark).replace(c.unionByName(s, allowMissingColumns=True).fillna("", ["segment"]).withColumn("country", F.lit("")))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    filled = t.change(lambda old: old.join(F.broadcast(names), "nation", "left").withColumn("country", F.when(F.col("country") == "", F.coalesce("n_name", F.lit(""))).otherwise(F.col("country"))).drop("n_name"))
    return filled.read().select("id", "name", "segment", "country")


@query("d11_partition_replace", "WITH new AS (SELECT o_custkey, o_orderkey, o_totalprice * 2 AS price FROM orders WHERE o_orderstatus = 'F') SELECT o_custkey, o_orderkey, o_totalprice AS price FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM new) AND o_custkey <> 7 UNION ALL SELECT * FROM new WHERE o_custkey <> 7")
def partition_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the keys that a batch holds are replaced by it; then one key is deleted whole."""
    o = table(spark, sf_dir, "orders")
    old = o.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    new = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", (F.col("o_totalprice") * 2).alias("price"))
    return VersionedTable(spark).replace(old).replace_keys(new, ["o_custkey"]).keep("o_custkey <> 7").read()


@query("a17_incremental_rollup", f"WITH {USERS_SQL} SELECT signal, bucket, count(DISTINCT install_id) AS total FROM metric_users GROUP BY ALL")
def incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct installs rolled up two signals a run; the cursor wraps, so that the third run begins anew."""
    members = metric_users(spark, sf_dir)
    signals = sorted(r["signal"] for r in members.select("signal").distinct().collect())  # a row for each kind of event
    roll = RollUp(spark)
    for _ in range(len(signals)):
        roll.refresh(members, signals, per_run=2)
    return roll.read()


_OLD_SQL = "CASE WHEN doc_id % 7 = 0 THEN 'old ' || text ELSE text END"


@query(
    "e11_index_sync",
    f"WITH was AS (SELECT doc_id, sha256({_OLD_SQL}) AS h FROM documents WHERE source <> 'src1'), now AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src2') SELECT CASE WHEN now.doc_id IS NULL THEN 'delete' WHEN was.doc_id IS NULL THEN 'insert' WHEN was.h = now.h THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n FROM was FULL OUTER JOIN now ON was.doc_id = now.doc_id GROUP BY 1",
)
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is brought up to date twice; the second run finds its state where the first wrote it.

    The first run sees the documents without one source and some of them in an older wording, the second one sees all but another source.
    """
    d = table(spark, sf_dir, "documents")
    state = BucketTable(spark, ["doc_id"])
    older = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    sync(state, d.where("source <> 'src1'").select("doc_id", F.sha2(older, 256).alias("h")), "doc_id", "h")
    actions = sync(state, d.where("source <> 'src2'").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")
    return actions.groupBy("action").agg(F.count("*").alias("n"))


@query("e12_resumed_cursor", "SELECT user_id, count(*) FILTER (WHERE event_id <= m // 2) AS first_run, count(*) FILTER (WHERE event_id > m // 2) AS second_run FROM events, (SELECT max(event_id) AS m FROM events) GROUP BY user_id")
def resumed_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that stops half-way and goes on after the sequence number that it wrote down."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    cursor = VersionedTable(spark).replace(e.agg(F.floor(F.max("event_id") / 2).alias("after_sequence")))
    after = cursor.read().first()["after_sequence"]
    runs = e.where(F.col("event_id") <= after).select("user_id", F.lit(1).alias("run")).unionByName(e.where(F.col("event_id") > after).select("user_id", F.lit(2).alias("run")))
    return runs.groupBy("user_id").agg(F.count_if(F.col("run") == 1).alias("first_run"), F.count_if(F.col("run") == 2).alias("second_run"))


@query(
    "s19_snapshots",
    "WITH l AS (SELECT user_id AS task, max(ts) AS updated, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS state FROM events GROUP BY user_id) SELECT task, state, row_number() OVER (ORDER BY updated DESC, task) AS place FROM l WHERE task % 9 <> 0",
)
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of tasks, newest first; those that can't be read are passed over (every ninth is torn here). A row a task is sorted."""
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("task")).agg(F.max("ts").alias("updated"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    raw = last.select(F.to_json(F.struct("task", F.unix_micros(F.col("updated").cast("timestamp")).alias("updated"), "state")).alias("raw"), "task")
    torn = raw.select(F.when(F.col("task") % 9 == 0, F.left("raw", F.lit(12))).otherwise(F.col("raw")).alias("raw"))
    read = torn.select(F.from_json("raw", "task bigint, updated bigint, state string").alias("s")).where("s.updated is not null").select("s.*")
    order = [F.desc("updated"), "task"]
    return read.select("task", "state", F.row_number().over(Window.orderBy(*order)).alias("place")).orderBy("place")


