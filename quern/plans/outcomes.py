"""More roll-ups of runs: profiles, phases, cognition, audits, and search over composed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import models
from quern.operators import ann, ranking, series, vectors
from quern.plans.registry import query
from quern.plans.scans import _RECORD_SQL, history
from quern.plans.search import TERMS, bm25_sql
from quern.plans.trajectories import _RESULTS_SQL, in_run, results, runs
from quern.sources.tables import table


@query("a27_solve_profiles", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN k END) AS first_pass, count(*) AS n FROM r GROUP BY user_id) SELECT CASE WHEN first_pass IS NULL THEN 'never' WHEN first_pass <= 5 THEN 'early' WHEN first_pass * 2 <= n THEN 'first_half' ELSE 'late' END AS profile, count(*) AS runs, list_sort(list(n))[count(*) // 2 + 1] AS median_steps FROM f GROUP BY 1")
def solve_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When runs first passed, with the upper median of their steps, from counts by value."""
    r = runs(spark, sf_dir).withColumn("k", F.row_number().over(in_run()))
    f = r.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "purchase", F.col("k"))).alias("first_pass"), F.count("*").alias("n"))
    profile = F.when(F.col("first_pass").isNull(), "never").when(F.col("first_pass") <= 5, "early").when(F.col("first_pass") * 2 <= F.col("n"), "first_half").otherwise("late")
    return series.upper_median(f.withColumn("profile", profile), ["profile"], "n").select("profile", F.col("rows").alias("runs"), F.col("median").alias("median_steps"))


@query("a28_cognition", "WITH r AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events) SELECT event_type, CAST(sum(cents) AS BIGINT) AS tokens, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.9) AS p90, count(*) FILTER (WHERE cents >= 3000) AS slow FROM r GROUP BY event_type")
def cognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, percentiles and a census of slow rounds."""
    r = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    p = series.percentiles(r, ["event_type"], "cents", {"p50": 50, "p90": 90})
    return r.groupBy("event_type").agg(F.sum("cents").alias("tokens"), F.count_if(F.col("cents") >= 3000).alias("slow")).join(p, "event_type").select("event_type", "tokens", "p50", "p90", "slow")


@query("a40_phase_trace", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS tools, count(*) FILTER (WHERE event_type = 'error') AS recoveries, count(*) FILTER (WHERE event_type = 'signup') AS plans, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS span_ms FROM events GROUP BY user_id")
def phase_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row for each run."""
    of = lambda k: F.count_if(F.col("event_type") == k)
    return runs(spark, sf_dir).groupBy("user_id").agg(of("view").alias("tools"), of("error").alias("recoveries"), of("signup").alias("plans"), (F.max("ms") - F.min("ms")).alias("span_ms"))


@query(
    "a43_outcome_rollup",
    f"WITH {_RESULTS_SQL}, o AS (SELECT *, CASE WHEN attempt > 0 THEN wall_ms // (attempt + 1) ELSE 0 END AS first_check, attempt = 2 AND NOT passed AS fell, wall_ms // 7 AS regret FROM results) SELECT class, count(*) AS n, CAST(sum(attempt) AS BIGINT) AS progress, max(wall_ms) AS longest, CAST(sum(CASE WHEN passed THEN wall_ms ELSE 0 END) AS BIGINT) AS useful_ms, count(*) FILTER (WHERE first_check > 0) AS checked, list_sort(list(first_check) FILTER (WHERE first_check > 0))[count(*) FILTER (WHERE first_check > 0) // 2 + 1] AS median_first_check, count(*) FILTER (WHERE fell) AS fell, CAST(sum(CASE WHEN fell THEN regret END) AS BIGINT) // nullif(count(*) FILTER (WHERE fell), 0) AS mean_regret, round(100.0 * count(*) FILTER (WHERE fell) / count(*), 6) AS fell_pct FROM o GROUP BY class",
)
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, maxima, the upper median over the runs that have the value, and the mean regret of the runs that ended below their best."""
    r = results(spark, sf_dir).withColumn("first_check", F.when(F.col("attempt") > 0, F.expr("wall_ms div (attempt + 1)")).otherwise(0)).withColumn("fell", (F.col("attempt") == 2) & ~F.col("passed"))
    median = series.upper_median(r.where("first_check > 0"), ["class"], "first_check").select("class", F.col("median").alias("median_first_check"))
    g = r.groupBy("class").agg(
        F.count("*").alias("n"), F.sum("attempt").alias("progress"), F.max("wall_ms").alias("longest"), F.sum(F.when(F.col("passed"), F.col("wall_ms")).otherwise(0)).alias("useful_ms"), F.count_if(F.col("first_check") > 0).alias("checked"),
        F.count_if("fell").alias("fell"), F.sum(F.when(F.col("fell"), F.expr("wall_ms div 7"))).alias("regret"),
    )
    return g.join(median, "class", "left").select("class", "n", "progress", "longest", "useful_ms", "checked", "median_first_check", "fell", F.expr("regret div nullif(fell, 0)").alias("mean_regret"), F.round(F.lit(100.0) * F.col("fell") / F.col("n"), 6).alias("fell_pct"))


# Audit records: what a route offered (by policy), what was missing at a gate and came later, what was called and failed, and what routing cost.
_AUDIT = {
    "routes": "event_type = 'view'", "semantic_routes": "event_type = 'view' AND k % 2 = 0", "semantic_fallbacks": "event_type = 'view' AND k % 8 = 0", "routed_require": "event_type = 'view' AND k < 10", "routed_prefer": "event_type = 'view' AND k BETWEEN 10 AND 39",
    "routed_suggest": "event_type = 'view' AND k >= 40", "declines": "event_type = 'click' AND k % 9 = 0", "require_missing": "event_type = 'error' AND k < 30", "require_recovered": "event_type = 'error' AND k < 30 AND value < 20", "prefer_missing": "event_type = 'error' AND k >= 30",
    "prefer_recovered": "event_type = 'error' AND k >= 30 AND value < 20", "skill_invocations": "event_type = 'click' AND k % 2 = 0", "skill_failures": "event_type = 'click' AND k % 2 = 0 AND value > 60", "skill_unavailable": "event_type = 'click' AND k % 2 = 0 AND value < 1", "tool_inspections": "event_type = 'click' AND k % 2 = 1 AND value < 5",
    "tool_calls": "event_type = 'click' AND k % 2 = 1 AND value >= 5", "tool_failures": "event_type = 'click' AND k % 2 = 1 AND value > 60", "review_blocks": "event_type = 'signup'", "security_review_blocks": "event_type = 'signup' AND k < 20",
}


@query(
    "a44_audit",
    "SELECT user_id % 10 AS capability, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _AUDIT.items()) + ", CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN k END), 0) AS BIGINT) AS router_tokens, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN CAST(round(value * 100) AS BIGINT) END), 0) AS BIGINT) AS router_latency FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of an audit log in one pass."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    spent = lambda c: F.coalesce(F.sum(F.when(F.col("event_type") == "view", c)), F.lit(0))
    counters = [F.count_if(F.expr(c)).alias(n) for n, c in _AUDIT.items()]
    return e.groupBy((F.col("user_id") % 10).alias("capability")).agg(*counters, spent(F.col("k")).alias("router_tokens"), spent(F.round(F.col("value") * 100).cast("bigint")).alias("router_latency"))


_BODY_SQL = "b AS (SELECT event_id, 'Exact version: 1.' || (event_id % 30) || '.' || (user_id % 4) || ' seen with node 18.2.0 and after 1.' || (CAST(json_extract(props, '$.k') AS BIGINT) % 30) || '.0' AS body FROM events WHERE event_type = 'error')"
_RELEASED_SQL = "released AS (SELECT DISTINCT '1.' || (event_id % 30) || '.' || (user_id % 3) AS version FROM events WHERE event_type = 'view')"


@query(
    "p16_stale_reports",
    f"WITH {_BODY_SQL}, {_RELEASED_SQL}, v AS (SELECT event_id, unnest(regexp_extract_all(body, '(\\d+\\.\\d+\\.\\d+)', 1)) AS version FROM b), m AS (SELECT event_id, max(struct_pack(a := CAST(split_part(version, '.', 1) AS INT), b := CAST(split_part(version, '.', 2) AS INT), c := CAST(split_part(version, '.', 3) AS INT))) AS best FROM v SEMI JOIN released USING (version) GROUP BY event_id) SELECT event_id, best.a || '.' || best.b || '.' || best.c AS newest FROM m WHERE best.a < 1 OR (best.a = 1 AND best.b < 17)",
)
def stale_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that are older than a cutoff, by the newest released version that they name anywhere; numbers that were never released tell nothing."""
    e = table(spark, sf_dir, "events")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    body = text("Exact version: 1.", F.col("event_id") % 30, ".", F.col("user_id") % 4, " seen with node 18.2.0 and after 1.", F.get_json_object("props", "$.k").cast("bigint") % 30, ".0")
    released = e.where("event_type = 'view'").select(text("1.", F.col("event_id") % 30, ".", F.col("user_id") % 3).alias("version")).distinct()
    named = e.where("event_type = 'error'").select("event_id", F.explode(F.regexp_extract_all(body, F.lit(r"(\d+\.\d+\.\d+)"), F.lit(1))).alias("version"))
    part = lambda i: F.split("version", r"\.")[i].cast("int")
    best = named.join(released, "version", "left_semi").groupBy("event_id").agg(F.max(F.struct(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))).alias("best"))
    return best.where("best.a < 1 or (best.a = 1 and best.b < 17)").select("event_id", F.concat_ws(".", "best.a", "best.b", "best.c").alias("newest"))




_COMPOSED = _RECORD_SQL + ", composed AS (SELECT f[1] AS id, array_to_string([trim(f[4]), trim(f[5]), f[3] || ' ' || f[2], array_to_string(list_distinct(regexp_extract_all(text, '[a-z]+\\.[a-z]+')), ' '), left(text, 1000)], chr(10)) AS text FROM history)"


@query("v02_composed_search", f"WITH {_COMPOSED}, {bm25_sql('composed', 'id', 'text')} SELECT id AS hash, round(score, 6) AS score FROM scored WHERE score >= 0.15 * (SELECT max(score) FROM scored) ORDER BY round(score, 6) DESC, id LIMIT 15")
def composed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: search over the records of a history: subject, body, who and when, files and the beginning of the diff are one text."""
    h = history(spark, sf_dir)
    text = F.concat_ws("\n", "subject", "body", F.concat_ws(" ", "author", "date"), F.array_join("files", " "), F.left(F.col("text"), F.lit(1000)))
    docs = h.select(F.col("hash").alias("id"), text.alias("text"))
    scored = ranking.floor(ranking.bm25(docs, TERMS, "id", F.col("text")), 0.15).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "id").limit(15).select(F.col("id").alias("hash"), "score")


@query("x01_embedded_search")
def embedded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code search with pluggable models: for each benchmark item the nearest documents by embedding, six for each place, those of some sources, ranked anew, ten places.

    The models are stand-ins: one embeds by hashes of words, one ranks by shared words. An item without a new score for
    a document keeps the order by cosine.
    """
    model = models.HashEmbedder(64)
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    docs = table(spark, sf_dir, "documents")
    asked, own = models.embed_with(items, model, "item_id", "text"), models.embed_with(docs, model, "doc_id", "text")
    found = ann.exact(own, asked, vectors.candidates(10), "id", "embedding")
    some = found.join(docs.select(F.col("doc_id").alias("id"), "source", F.col("text").alias("text")), "id").where(F.col("source").startswith("src1"))
    some = some.join(F.broadcast(items.select(F.col("item_id").cast("bigint").alias("query"), F.col("text").alias("asked"))), "query")
    ranked = models.rerank_with(some.select("query", "id", "score", "asked", "text"), models.OverlapReranker(), "asked", "text")
    order = [F.desc_nulls_last("second"), F.desc("score"), "id"]
    return ranking.top_per(ranked, ["query"], order, 10).select("query", "id", "score", F.col("second"), F.col("rn").alias("place"))
