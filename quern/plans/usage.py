"""Usage and cost: totals by day, model and provider, rankings, top-N with a rest, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import provider
from quern.operators import series
from quern.operators.lineage import cut
from quern.plans.registry import query
from quern.sources.tables import USAGE_SQL, table, usage

_PROVIDER_SQL = "CASE WHEN instr(model, '/') > 1 THEN split_part(model, '/', 1) ELSE 'default' END"
_REQ_SQL = "CASE WHEN turn THEN 0 WHEN requests <= 0 AND total > 0 THEN 1 ELSE requests END"


def requests():
    """Requests of a record; records from before they were counted have one if they have tokens."""
    return F.when(F.col("turn"), 0).when((F.col("requests") <= 0) & (F.col("total") > 0), 1).otherwise(F.col("requests"))


@query(
    "a09_range_stats",
    f"""WITH {USAGE_SQL}, u AS (SELECT *, {_REQ_SQL} AS req FROM usage WHERE source = 'cli')
SELECT date, CAST(sum(CASE WHEN turn THEN 0 ELSE total END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN turn THEN 0 ELSE cache_hit END) AS BIGINT) AS cache_hit, CAST(sum(req) AS BIGINT) AS requests, count(*) FILTER (WHERE turn) AS turns,
  sum(CASE WHEN turn THEN 0 ELSE total END) > 0 OR sum(req) > 0 AS active, round(100.0 * sum(CASE WHEN turn THEN 0 ELSE total END) / (SELECT sum(CASE WHEN turn THEN 0 ELSE total END) FROM u), 6) AS pct FROM u GROUP BY date""",
    dates=("date",),
)
def range_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, requests and turns of one source by day, with the share of all tokens."""
    u = series.where_given(usage(spark, sf_dir), source="cli").withColumn("req", requests()).withColumn("tok", F.when(F.col("turn"), 0).otherwise(F.col("total")))
    d = u.groupBy("date").agg(F.sum("tok").alias("tokens"), F.sum(F.when(F.col("turn"), 0).otherwise(F.col("cache_hit"))).alias("cache_hit"), F.sum("req").alias("requests"), F.count_if("turn").alias("turns"))
    total = d.agg(F.sum("tokens").alias("all_tokens"))
    return d.join(F.broadcast(total)).select("date", "tokens", "cache_hit", "requests", "turns", ((F.col("tokens") > 0) | (F.col("requests") > 0)).alias("active"), F.round(100.0 * F.col("tokens") / F.col("all_tokens"), 6).alias("pct"))


@query("a10_model_ranking", f"WITH {USAGE_SQL} SELECT model, {_PROVIDER_SQL} AS provider, CAST(sum(total) AS BIGINT) AS tokens, row_number() OVER (ORDER BY sum(total) DESC, model) AS place FROM usage WHERE NOT turn AND total > 0 GROUP BY model")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by tokens, then by name."""
    m = usage(spark, sf_dir).where("not turn and total > 0").groupBy("model").agg(F.sum("total").alias("tokens"))
    return m.select("model", provider(F.col("model")).alias("provider"), "tokens", F.row_number().over(Window.orderBy(F.desc("tokens"), "model")).alias("place"))  # one row a model


@query(
    "a11_top_and_other",
    f"""WITH {USAGE_SQL}, t AS (SELECT model FROM usage WHERE NOT turn GROUP BY model ORDER BY sum(total) DESC, model LIMIT 5)
SELECT date, CASE WHEN model IN (SELECT model FROM t) THEN model ELSE 'Other' END AS shown, CAST(sum(total) AS BIGINT) AS tokens FROM usage WHERE NOT turn GROUP BY ALL""",
    dates=("date",),
)
def top_and_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest models by day, and all others as one."""
    u = usage(spark, sf_dir).where("not turn").groupBy("date", "model").agg(F.sum("total").alias("total"))
    return series.top_and_other(u, "model", "total", 5).groupBy("date", "shown").agg(F.sum("total").alias("tokens"))


@query(
    "r08_day_model_maps",
    f"""WITH {USAGE_SQL}, d AS (SELECT date, {_PROVIDER_SQL} AS provider, sum(total) AS t FROM usage WHERE NOT turn AND total > 0 GROUP BY ALL)
SELECT date, count(*) AS n_providers, CAST(sum(t) AS BIGINT) AS tokens, arg_max(provider, struct_pack(a := t, b := provider)) AS top_provider FROM d GROUP BY date""",
    dates=("date",),
)
def day_model_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map from provider to tokens for each day, and what is read from it."""
    d = usage(spark, sf_dir).where("not turn and total > 0").groupBy("date", provider(F.col("model")).alias("provider")).agg(F.sum("total").alias("t"))
    m = d.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("provider", "t"))).alias("by_provider"))
    entries = F.map_entries("by_provider")
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("t"), e["key"].alias("p"))))
    return m.select("date", F.size("by_provider").cast("bigint").alias("n_providers"), F.aggregate(F.map_values("by_provider"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"), top["p"].alias("top_provider"))


_COST_SQL = """
c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 10 AS BIGINT) AS prompt, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity * 4 AS BIGINT) END AS hit, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_quantity * 5 AS BIGINT) END AS miss, CAST(l_quantity AS BIGINT) AS wr, CAST(l_quantity * 3 AS BIGINT) AS completion FROM lineitem),
m AS (SELECT *, CASE WHEN hit + miss = 0 AND prompt > 0 THEN prompt WHEN miss = 0 AND hit > 0 AND prompt > hit THEN prompt - hit ELSE miss END AS ms FROM c),
w AS (SELECT *, greatest(0, least(wr, ms)) AS wc FROM m)"""


@query("a30_cost_estimate", f"WITH {_COST_SQL} SELECT l_orderkey, CAST(sum(hit * 1 + (ms - wc + CASE WHEN wc > 0 THEN wc * 2 ELSE 0 END) * 10 + completion * 40) AS BIGINT) AS micro_cost FROM w GROUP BY l_orderkey")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price of cached, missed, written and completed tokens, in whole units, so that sums are exact."""
    q = F.col("l_quantity")
    c = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (q * 10).cast("bigint").alias("prompt"), F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise((q * 4).cast("bigint")).alias("hit"),
        F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise((q * 5).cast("bigint")).alias("miss"), q.cast("bigint").alias("wr"), (q * 3).cast("bigint").alias("completion"),
    )
    return c.groupBy("l_orderkey").agg(F.sum(cost("prompt", "hit", "miss", "wr", "completion", 1, 10, 40)).alias("micro_cost"))


def cost(prompt: str, hit: str, miss: str, write: str, completion: str, p_hit: int, p_in: int, p_out: int, write_factor: int = 2):
    """Cost of a request. Without cache figures the whole prompt is a miss; with hits alone, the rest of it is."""
    h, m, p = F.col(hit), F.col(miss), F.col(prompt)
    ms = F.when((h + m == 0) & (p > 0), p).when((m == 0) & (h > 0) & (p > h), p - h).otherwise(m)
    wc = F.greatest(F.lit(0), F.least(F.col(write), ms))
    return h * p_hit + (ms - wc + F.when(wc > 0, wc * write_factor).otherwise(0)) * p_in + F.col(completion) * p_out


@query("a31_store_stats", "SELECT source AS workspace, count(DISTINCT doc_id) AS paths, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunks, max(lang) AS model FROM documents GROUP BY source ORDER BY 2, 1")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and chunks of each workspace, the smallest first; a line is a chunk here."""
    chunk = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace"), F.col("doc_id").alias("path"), "lang", F.size(F.split("text", "\n", -1)).alias("n"))
    return chunk.groupBy("workspace").agg(F.countDistinct("path").alias("paths"), F.sum("n").cast("bigint").alias("chunks"), F.max("lang").alias("model")).orderBy("paths", "workspace")


@query("a36_attempt_usage", f"WITH {USAGE_SQL} SELECT event_id // 10 AS call_id, CAST(sum(total) AS BIGINT) AS billed, arg_max(total, event_id) AS context FROM usage GROUP BY 1")
def attempt_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts are billed; the context is that of the latest."""
    return usage(spark, sf_dir).groupBy(F.floor(F.col("event_id") / 10).alias("call_id")).agg(F.sum("total").alias("billed"), F.max_by("total", "event_id").alias("context"))


@query(
    "a39_apportionment",
    """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM g),
f AS (SELECT source, n, n * 60 // total AS base, (n * 60) % total AS rest FROM g, t),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS rn, 60 - sum(base) OVER () AS spare FROM f),
s AS (SELECT source, n, base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS slots FROM r),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS pos FROM documents)
SELECT d.doc_id, d.source FROM d JOIN s USING (source) WHERE slots > 0 AND pos IN (SELECT ((2 * i + 1) * s.n) // (2 * slots) FROM (SELECT unnest(range(0, 60)) AS i) WHERE i < slots)""",
)
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty places shared out by largest remainders, then evenly spaced picks in each group."""
    docs = table(spark, sf_dir, "documents")
    g = docs.groupBy("source").agg(F.count("*").alias("n"))
    f = g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("source", "n", F.floor(F.col("n") * 60 / F.col("total")).alias("base"), (F.col("n") * 60 % F.col("total")).alias("rest"))
    ranked = f.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rest"), "source"))).withColumn("spare", 60 - F.sum("base").over(Window.partitionBy()))  # one row a source
    s = ranked.select("source", "n", (F.col("base") + (F.col("rn") <= F.col("spare")).cast("int")).alias("slots")).where("slots > 0")
    picks = s.select("source", F.explode(F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda i: F.expr("0") + F.floor((2 * i + 1) * F.col("n") / (2 * F.col("slots"))))).alias("pos"))
    # What is sorted are counts by size; of the documents only those of the few sizes at which a place lies are looked at.
    upto = F.sum("m").over(Window.partitionBy("source").orderBy("n_chars"))
    sizes = docs.groupBy("source", "n_chars").agg(F.count("*").alias("m")).withColumn("first", upto - F.col("m")).withColumn("upto", upto)
    at = cut(sizes.join(F.broadcast(picks), "source").where("pos >= first and pos < upto").select("source", "n_chars", (F.col("pos") - F.col("first")).alias("nth")))  # sixty rows at most
    near = docs.select("doc_id", "source", "n_chars").join(F.broadcast(at.select("source", "n_chars").distinct()), ["source", "n_chars"])
    placed = near.withColumn("nth", (F.row_number().over(Window.partitionBy("source", "n_chars").orderBy("doc_id")) - 1).cast("bigint"))
    return placed.join(F.broadcast(at), ["source", "n_chars", "nth"]).select("doc_id", "source")


@query("a41_agreement", "WITH v AS (SELECT quality, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS pred FROM documents JOIN labels USING (doc_id)) SELECT pred, count(*) AS n, count(*) FILTER (WHERE pred = quality) AS agree, round(100.0 * count(*) FILTER (WHERE pred = quality) / count(*), 6) AS pct FROM v GROUP BY pred")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a rule says what the label says."""
    v = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 200).cast("int").alias("pred")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    a = v.groupBy("pred").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("quality")).alias("agree"))
    return a.withColumn("pct", F.round(100.0 * F.col("agree") / F.col("n"), 6))


@query("a38_token_estimates", "SELECT conv_id, CAST(sum(greatest(length(text), (strlen(text) + 3) // 4) + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a conversation by its characters and bytes, with four for each message's frame."""
    from quern.functions.text import token_estimate

    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(token_estimate(F.col("text")) + 4).alias("tokens"))


@query("s01_day_scan", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'")
def day_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days; the comparison is on the column itself, so that row groups are passed over."""
    return table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-13'").select("event_id", "value")


@query("s02_tolerant_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode what can be decoded with a fixed narrow schema and drop the rest; every seventh line is torn here."""
    torn = F.when(F.col("event_id") % 7 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(torn, "k bigint").alias("j")).where("j.k is not null").select("event_id", F.col("j.k").alias("k"))


@query("s19_after_sequence", "SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_id > 500")
def after_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log holds after a given sequence number."""
    return table(spark, sf_dir, "events").where("user_id = 7 and event_id > 500").select("event_id", "user_id")


@query("s24_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three lines of each log."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("s13_glob", "SELECT url FROM pages WHERE regexp_matches(url, '^https?://[^/]*\\.example\\.org/.*$') ORDER BY url LIMIT 1000")
def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a pattern matches, in order and at most a thousand."""
    from quern.functions.globs import glob_regex

    any_of = glob_regex("http*://*.example.org/**")
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(any_of)).select("url").orderBy("url").limit(1000)


@query("p09_glob_set", "SELECT page_id FROM pages WHERE (regexp_matches(url, '^https?://[^/]*/en/.*$') OR regexp_matches(url, '^https?://[^/]*/de/.*$')) AND NOT regexp_matches(url, '^https?://blog[^/]*/.*$')")
def glob_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of some patterns and none of others."""
    from quern.functions.globs import glob_set as matches

    return table(spark, sf_dir, "pages").where(matches(F.col("url"), ["http*://*/en/**", "http*://*/de/**"], ["http*://blog*/**"])).select("page_id")


@query("e01_daily_usage_days", f"WITH {USAGE_SQL} SELECT source, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM usage GROUP BY source", dates=("first_day", "last_day"))
def usage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active days of each source."""
    return usage(spark, sf_dir).groupBy("source").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query(
    "a37_readiness",
    "WITH accepted AS (SELECT l_orderkey AS criterion, count(*) AS evidence FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), c AS (SELECT o_custkey AS task, count(*) AS required, count(*) FILTER (WHERE evidence IS NULL) AS missing, CAST(coalesce(sum(evidence), 0) AS BIGINT) AS evidence FROM orders LEFT JOIN accepted ON criterion = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey) SELECT c_custkey AS task, CASE WHEN c_acctbal < 0 THEN 'task is blocked' ELSE '' END AS blocked, coalesce(required, 0) AS required, coalesce(missing, 0) AS missing, coalesce(evidence, 0) AS evidence, c_acctbal >= 0 AND coalesce(missing, 0) = 0 AS ready FROM customer LEFT JOIN c ON task = c_custkey",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every required criterion of a task has accepted evidence; a blocked task is not ready, whatever it has."""
    accepted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("found"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey").join(accepted, "o_orderkey", "left")
    c = o.groupBy(F.col("o_custkey").alias("task")).agg(F.count("*").alias("required"), F.count_if(F.col("found").isNull()).alias("missing"), F.coalesce(F.sum("found"), F.lit(0)).alias("evidence"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), (F.col("c_acctbal") < 0).alias("stuck")).join(c, "task", "left").fillna(0, ["required", "missing", "evidence"])
    return t.select("task", F.when(F.col("stuck"), "task is blocked").otherwise("").alias("blocked"), "required", "missing", "evidence", (~F.col("stuck") & (F.col("missing") == 0)).alias("ready"))