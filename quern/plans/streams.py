"""Streams run over the event files, and batch forms of what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.versioned import VersionedTable
from quern.plans.registry import query
from quern.sources.tables import table
from quern.streaming import calls, coalesce, fanout, runs


@query("st01_hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows with a watermark, over the stream."""
    rows = runs.latest_update(runs.updates(runs.hourly_counts(runs.event_stream(spark, sf_dir))), ["hour", "event_type"], "n")
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("st02_turn_counters", "WITH t AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) SELECT user_id, CAST(turn AS BIGINT) AS turn, count(*) AS n FROM t GROUP BY ALL")
def turn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as state of a stream."""
    return runs.latest_update(runs.updates(runs.turn_counters(runs.event_stream(spark, sf_dir))), ["user_id", "turn"], "n")


@query("st03_upsert_counters", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that each batch of a stream adds to."""
    return runs.merge_counters(runs.event_stream(spark, sf_dir), ["event_type", "user_id"])


@query("st04_distinct_stream", "SELECT DISTINCT user_id, event_type, props FROM events")
def distinct_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is announced again is passed over."""
    return runs.updates(runs.first_seen(runs.event_stream(spark, sf_dir), ["user_id", "event_type", "props"]), "append").drop("batch")


_QUIET_SQL = "r AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM r)"


@query("e02_quiet_sessions", f"WITH {_QUIET_SQL} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, k")
def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events that end when nothing comes for twelve hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("st06_debounced", f"WITH {_QUIET_SQL} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream, which acts once on a burst, when the watermark tells that it has been quiet long enough; bursts that may go on are held back."""
    s = runs.updates(runs.debounced(runs.event_stream(spark, sf_dir), "12 hours", "1 minute"), "append")
    return s.select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("st05_sliding_counts", "WITH w AS (SELECT ts, event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS h FROM events) SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of two hours, one an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


_LOG_SQL = "b AS (SELECT *, coalesce(max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id), 0) AS base FROM conversations), m AS (SELECT *, turn >= base AS live, sum(strlen(text)) OVER (PARTITION BY conv_id) AS log_bytes, sum(CASE WHEN turn >= base AND role <> 'assistant' THEN strlen(text) ELSE 0 END) OVER (PARTITION BY conv_id) AS live_bytes FROM b)"


@query(
    "e06_log_compaction",
    f"WITH {_LOG_SQL}, c AS (SELECT conv_id, turn, role, strlen(text) AS n, log_bytes > 4 * live_bytes AND log_bytes > 1024 AS compact, live AND role <> 'assistant' AS kept FROM m) SELECT conv_id, CASE WHEN compact THEN 'snapshot' ELSE 'log' END AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, turn, n FROM c WHERE kept OR NOT compact",
)
def log_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that are more than four times as large as what is live in them, and large at all, are written anew as a snapshot of that; others stay as they are."""
    return runs.compacted(table(spark, sf_dir, "conversations"), 4, 1024).select("conv_id", "kind", "idx", "turn", F.octet_length("text").alias("n"))

# Deltas of text and of reasoning among other events; some carry more than text. Hours stand for milliseconds here.
WINDOW, MOST = 6 * 3_600_000, 40
_DELTA_SQL = f"""e AS (
  SELECT user_id, ms, kind, text, kind IN ('text', 'reasoning') AND NOT other AS delta, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn
  FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'reasoning' ELSE event_type END AS kind, props AS text, event_id % 17 = 0 AS other FROM events)
),
r AS (
  SELECT user_id, 0::BIGINT AS rn, -(1::BIGINT << 61) AS last, NULL::VARCHAR AS held, 0::BIGINT AS since, 0::BIGINT AS size, 0::BIGINT AS grp, '' AS why FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, rn, CASE WHEN fills THEN ms ELSE l3 END, CASE WHEN joins AND NOT fills THEN kind END, s3, z3, grp + CASE WHEN joins AND h2 IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN NOT delta THEN 'other' WHEN now THEN 'first' WHEN fills THEN 'size' ELSE 'waits' END
  FROM (
    SELECT *, joins AND z3 >= {MOST} AS fills FROM (
      SELECT *, delta AND NOT now AS joins, CASE WHEN now THEN ms ELSE l2 END AS l3, CASE WHEN delta AND NOT now AND h2 IS NULL THEN ms ELSE since END AS s3, CASE WHEN delta AND NOT now THEN CASE WHEN h2 IS NULL THEN 0 ELSE size END + strlen(text) ELSE 0 END AS z3 FROM (
        SELECT *, delta AND h2 IS NULL AND ms - l2 >= {WINDOW} AS now FROM (
          SELECT *, CASE WHEN h1 IS NOT NULL AND (NOT delta OR h1 <> kind) THEN ms ELSE l1 END AS l2, CASE WHEN h1 IS NOT NULL AND (NOT delta OR h1 <> kind) THEN NULL ELSE h1 END AS h2 FROM (
            SELECT e.*, r.since, r.size, r.grp, CASE WHEN r.held IS NOT NULL AND e.ms >= r.since + {WINDOW} THEN r.since + {WINDOW} ELSE r.last END AS l1, CASE WHEN r.held IS NOT NULL AND e.ms >= r.since + {WINDOW} THEN NULL ELSE r.held END AS h1
            FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)))))
),
g AS (
  SELECT e.user_id, r.grp, any_value(e.kind) AS kind, string_agg(e.text, '' ORDER BY e.rn) AS text, CAST(count(*) AS INTEGER) AS n, min(e.ms) AS first_ms, max(e.ms) AS last_ms, arg_max(r.why, e.rn) AS closed, max(e.rn) AS rn
  FROM r JOIN e USING (user_id, rn) GROUP BY e.user_id, r.grp
),
d AS (
  SELECT g.user_id, g.kind, g.text, n, first_ms, CASE WHEN closed = 'waits' THEN least(first_ms + {WINDOW}, coalesce(e.ms, first_ms + {WINDOW})) ELSE last_ms END AS at_ms,
         CASE WHEN closed <> 'waits' THEN closed WHEN coalesce(e.ms, first_ms + {WINDOW}) >= first_ms + {WINDOW} THEN 'time' WHEN e.delta THEN 'kind' ELSE 'barrier' END AS why
  FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1
)"""


def delta_rows(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "reasoning").otherwise(F.col("event_type"))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), ms.alias("ms"), kind.alias("kind"), F.col("props").alias("text"), (F.col("event_id") % 17 == 0).alias("other"), F.col("ts").cast("timestamp").alias("ts"))


@query("e01_deltas", f"WITH RECURSIVE {_DELTA_SQL} SELECT * FROM d")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas that follow each other closely as one event, with bounds of time and size; any other event is a barrier, and the first delta goes at once."""
    return coalesce.coalesce(delta_rows(table(spark, sf_dir, "events")), ["text", "reasoning"], WINDOW, MOST).withColumnRenamed("key", "user_id")


@query("e01_delta_stream", f"WITH RECURSIVE {_DELTA_SQL} SELECT * FROM d WHERE at_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 60000")
def delta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream, as state with a timer; what goes out up to the watermark."""
    s = coalesce.coalesce_stream(delta_rows(runs.event_stream(spark, sf_dir)), ["text", "reasoning"], "1 minute", WINDOW, MOST)
    return runs.updates(s, "append").drop("batch").withColumnRenamed("key", "user_id")


_CALLS_SQL = """c AS (SELECT user_id, user_id || '-' || (event_id % 5) AS call, ts AS called FROM events WHERE event_type = 'view' AND event_id % 13 <> 0),
a AS (SELECT user_id, user_id || '-' || (event_id % 5) AS call, ts AS answered, CAST(floor(value * 1000) AS BIGINT) AS ms FROM events WHERE event_type IN ('click', 'purchase')),
j AS (SELECT coalesce(c.user_id, a.user_id) AS user_id, coalesce(c.call, a.call) AS call, called, answered, ms FROM c FULL JOIN a ON c.user_id = a.user_id AND c.call = a.call AND answered BETWEEN called AND called + INTERVAL 12 HOURS),
k AS (SELECT * FROM j WHERE coalesce(called, answered) <= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS),
s AS (
  SELECT user_id, called, answered, ms, CASE WHEN called IS NULL THEN 'orphan' ELSE 'answered' END AS state FROM (SELECT user_id, call, answered, ms, max(called) AS called FROM k WHERE answered IS NOT NULL GROUP BY ALL)
  UNION ALL SELECT user_id, called, NULL, NULL, 'open' FROM (SELECT user_id, call, called, bool_or(answered IS NOT NULL) AS heard FROM k WHERE called IS NOT NULL GROUP BY user_id, call, called) w WHERE NOT heard AND called = (SELECT max(called) FROM k WHERE k.user_id = w.user_id AND k.call = w.call)
)"""


@query(
    "e08_calls",
    f"""WITH {_CALLS_SQL} SELECT user_id, count(*) FILTER (state = 'answered') AS answered, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'orphan') AS orphans,
    CAST(coalesce(sum(epoch_us(answered) // 1000 - ms - epoch_us(called) // 1000) FILTER (state = 'answered' AND epoch_us(answered) // 1000 - ms >= epoch_us(called) // 1000), 0) AS BIGINT) AS start_delay_ms,
    CAST(coalesce(sum(ms), 0) AS BIGINT) AS tool_ms, CAST(coalesce(sum(ms) FILTER (state = 'orphan'), 0) AS BIGINT) AS orphan_ms FROM s GROUP BY user_id""",
)
def settled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls announced more than once, their results, and results that nothing announced, by an outer join of two streams; what the watermark has passed."""
    call = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_id") % 5)
    rows = lambda: runs.event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), call.alias("call"), "ts", "event_type", (F.col("event_id") % 13 == 0).alias("refreshed"), F.floor(F.col("value") * 1000).alias("ms"))
    told, came = rows().where("event_type = 'view'"), rows().where("event_type in ('click', 'purchase')")
    upto = table(spark, sf_dir, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 3 DAYS")).alias("upto"))
    found = runs.updates(calls.joined(told, came, "1 hour", "12 HOURS"), "append").drop("batch")
    held = found.join(F.broadcast(upto), F.coalesce("called", "answered") <= F.col("upto")).drop("upto")
    return calls.totals(calls.settled(held)).withColumnRenamed("key", "user_id")


@query("e09_fan_out", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY ALL) SELECT user_id, event_type, n, last_event, n AS logged FROM n JOIN l USING (user_id, event_type)")
def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream to a log of batches, a table of counters, and a table of latest rows, each of which takes a batch once."""
    base, keys = runs.folder(spark), ["user_id", "event_type"]
    counts, last = VersionedTable(spark, f"{base}/counts"), VersionedTable(spark, f"{base}/last")
    stream = runs.event_stream(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    fanout.fan_out(stream, [fanout.Files(f"{base}/log"), None, fanout.Counters(counts, keys), fanout.Latest(last, keys, ["ts", "event_id"])], f"{base}/run")
    logged = spark.read.parquet(f"{base}/log").groupBy(*keys).agg(F.count("*").alias("logged"))
    return counts.read().join(last.read().select(*keys, F.col("event_id").alias("last_event")), keys).join(logged, keys)
