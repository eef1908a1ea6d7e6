"""Usage telemetry: windows, distinct counts, deltas, roll-ups, upserts and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import series
from quern.operators.ranking import top_per
from quern.plans.registry import query
from quern.sources.tables import AS_OF_SQL, BUCKET_SQL, METRICS_SQL, PINGS_SQL, USERS_SQL, events, metric_users, metrics, pings, table, value_bucket, with_as_of


@query("a01_window_sums", f"WITH {METRICS_SQL}, {AS_OF_SQL} SELECT signal, bucket, CAST(sum(n) AS BIGINT) AS total FROM metrics, as_of WHERE date >= d - 6 GROUP BY ALL")
def window_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the last seven days by signal and bucket."""
    m = with_as_of(metrics(spark, sf_dir), spark, sf_dir).where(F.col("date") >= F.date_sub("as_of", 6))
    return m.groupBy("signal", "bucket").agg(F.sum("n").alias("total"))


@query("a02_distinct_users", f"WITH {USERS_SQL}, {AS_OF_SQL} SELECT signal, bucket, count(DISTINCT install_id) AS users FROM metric_users, as_of WHERE date >= d - 6 GROUP BY ALL")
def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: installs of the last seven days by signal and bucket; exact, with partial distinct on the map side."""
    m = with_as_of(metric_users(spark, sf_dir), spark, sf_dir).where(F.col("date") >= F.date_sub("as_of", 6))
    return m.select("signal", "bucket", "install_id").distinct().groupBy("signal", "bucket").agg(F.count("*").alias("users"))


@query("a02_sketched_users", f"WITH {USERS_SQL} SELECT signal, count(DISTINCT install_id) > 0 AS seen FROM metric_users GROUP BY signal")
def sketched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A17 at scale: sketches by day that can be merged over any window; here, whether the estimate is near the exact count."""
    users = metric_users(spark, sf_dir)
    daily = users.groupBy("date", "signal").agg(F.hll_sketch_agg("install_id").alias("sketch"))
    merged = daily.groupBy("signal").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = users.groupBy("signal").agg(F.countDistinct("install_id").alias("exact"))
    return merged.join(exact, "signal").select("signal", (F.abs(F.col("estimate") - F.col("exact")) <= 0.1 * F.col("exact") + 1).alias("seen"))


@query("a03_adoption", f"WITH {PINGS_SQL}, {AS_OF_SQL} SELECT date, count(DISTINCT install_id) AS installs, count(DISTINCT CASE WHEN version = 'v1.4.0' THEN install_id END) AS on_latest, round(100.0 * count(DISTINCT CASE WHEN version = 'v1.4.0' THEN install_id END) / nullif(count(DISTINCT install_id), 0), 6) AS adoption_pct FROM pings, as_of WHERE date >= d - 6 GROUP BY date", dates=("date",))
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the installs that run the newest version, by day."""
    p = with_as_of(pings(spark, sf_dir), spark, sf_dir).where(F.col("date") >= F.date_sub("as_of", 6))
    newest = series.newest_version(pings(spark, sf_dir).select("version").distinct())
    p = p.join(F.broadcast(newest))
    out = p.groupBy("date").agg(F.countDistinct("install_id").alias("installs"), F.countDistinct(F.when(F.col("version") == F.col("newest"), F.col("install_id"))).alias("on_latest"))
    return out.withColumn("adoption_pct", F.round(100.0 * F.col("on_latest") / F.nullif(F.col("installs"), F.lit(0)), 6))


@query("a04_having_distinct", f"WITH {PINGS_SQL} SELECT version, count(DISTINCT install_id) AS installs FROM pings GROUP BY version HAVING count(DISTINCT install_id) >= 2")
def having_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: versions with at least two installs."""
    return pings(spark, sf_dir).groupBy("version").agg(F.countDistinct("install_id").alias("installs")).where("installs >= 2")


@query("a05_overview", f"WITH {METRICS_SQL}, {AS_OF_SQL} SELECT CAST(coalesce(sum(CASE WHEN signal = 'error' THEN n END), 0) AS BIGINT) AS errors, CAST(coalesce(sum(CASE WHEN signal = 'purchase' THEN n END), 0) AS BIGINT) AS purchases, CAST(coalesce(sum(CASE WHEN signal = 'signup' AND date = d THEN n END), 0) AS BIGINT) AS signups_today, CAST(coalesce(sum(CASE WHEN bucket = 'none_such' THEN n END), 0) AS BIGINT) AS absent FROM metrics, as_of")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: conditional sums in a single pass; a sum over nothing is 0."""
    m = with_as_of(metrics(spark, sf_dir), spark, sf_dir)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return m.agg(
        total(F.col("signal") == "error").alias("errors"), total(F.col("signal") == "purchase").alias("purchases"),
        total((F.col("signal") == "signup") & (F.col("date") == F.col("as_of"))).alias("signups_today"), total(F.col("bucket") == "none_such").alias("absent"),
    )


@query("a06_daily_actives", f"WITH {PINGS_SQL} SELECT date, count(*) AS users, CAST(sum(opens) AS BIGINT) AS opens FROM pings GROUP BY date", dates=("date",))
def daily_actives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs and openings by day."""
    return pings(spark, sf_dir).groupBy("date").agg(F.count("*").alias("users"), F.sum("opens").alias("opens"))


@query("a07_version_bars", f"WITH {PINGS_SQL} SELECT version, count(DISTINCT install_id) AS installs FROM pings GROUP BY version ORDER BY installs DESC, version LIMIT 15")
def version_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most used versions."""
    return pings(spark, sf_dir).groupBy("version").agg(F.countDistinct("install_id").alias("installs")).orderBy(F.desc("installs"), "version").limit(15)


@query("a08_gap_filled", f"WITH {AS_OF_SQL}, days AS (SELECT CAST(unnest(generate_series(d - 44, d, INTERVAL 1 DAY)) AS DATE) AS date FROM as_of), c AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT date, coalesce(n, 0) AS n FROM days LEFT JOIN c USING (date)", dates=("date",))
def gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count for each of the last 45 days, 0 where there is none."""
    e = events(spark, sf_dir)
    counts = e.where("event_type = 'purchase'").groupBy("date").agg(F.count("*").alias("n"))
    return series.fill_days(counts, e.agg(F.max("date").alias("as_of")), 45, ["n"])


@query("a13_weighted_midpoint", f"WITH {METRICS_SQL}, mid AS (SELECT signal, n, CASE bucket WHEN 'v_1_5' THEN 3.0 WHEN 'v_5_15' THEN 10.0 WHEN 'v_15_60' THEN 37.5 ELSE 0 END AS mid FROM metrics) SELECT signal, round(sum(CAST(mid * 2 * n AS BIGINT)) / 2.0 / nullif(sum(n), 0), 6) AS mean_mid FROM mid GROUP BY signal")
def weighted_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the buckets' middles, weighted by their counts; a bucket without two ends counts as 0."""
    low, high = (F.nullif(F.regexp_extract("bucket", r"^v_(\d+)_(\d+)$", i), F.lit("")).cast("int") for i in (1, 2))
    double_mid = F.coalesce(low + high, F.lit(0))
    return metrics(spark, sf_dir).groupBy("signal").agg(F.round(F.sum(double_mid * F.col("n")) / 2.0 / F.nullif(F.sum("n"), F.lit(0)), 6).alias("mean_mid"))


@query("a14_rate_per_100", f"WITH {METRICS_SQL} SELECT date, round(100.0 * sum(CASE WHEN signal = 'error' THEN n ELSE 0 END) / nullif(sum(CASE WHEN signal = 'signup' THEN n ELSE 0 END), 0), 6) AS errors_per_100 FROM metrics GROUP BY date", dates=("date",))
def rate_per_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors for 100 turns by day; null on days without turns."""
    of = lambda s: F.sum(F.when(F.col("signal") == s, F.col("n")).otherwise(0))
    return metrics(spark, sf_dir).groupBy("date").agg(F.round(100.0 * of("error") / F.nullif(of("signup"), F.lit(0)), 6).alias("errors_per_100"))


@query(
    "a15_period_delta",
    f"""WITH {METRICS_SQL}, {AS_OF_SQL},
p AS (SELECT signal, bucket, CAST(sum(CASE WHEN date >= d - 6 THEN n END) AS BIGINT) AS now_n, CAST(sum(CASE WHEN date >= d - 13 AND date < d - 6 THEN n END) AS BIGINT) AS prev_n FROM metrics, as_of GROUP BY ALL)
SELECT signal, bucket, now_n, prev_n, CASE WHEN now_n IS NULL OR prev_n IS NULL THEN 'new' WHEN abs(now_n - prev_n) / CAST(prev_n AS DOUBLE) < 0.05 THEN 'flat' WHEN now_n > prev_n THEN 'up' ELSE 'down' END AS change FROM p""",
)
def period_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven days against the seven days before, in one pass over both."""
    m = with_as_of(metrics(spark, sf_dir), spark, sf_dir)
    return series.against_previous(m, ["signal", "bucket"], 7)


@query("a15_health_bands", f"WITH {METRICS_SQL} SELECT date, CAST(sum(CASE WHEN signal = 'error' THEN n ELSE 0 END) AS BIGINT) AS errors, CASE WHEN sum(CASE WHEN signal = 'error' THEN n ELSE 0 END) <= 0 THEN 'good' WHEN sum(CASE WHEN signal = 'error' THEN n ELSE 0 END) <= 2 THEN 'warn' ELSE 'bad' END AS health FROM metrics GROUP BY date", dates=("date",))
def health_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a daily count."""
    errors = metrics(spark, sf_dir).groupBy("date").agg(F.sum(F.when(F.col("signal") == "error", F.col("n")).otherwise(0)).alias("errors"))
    return errors.withColumn("health", F.when(F.col("errors") <= 0, "good").when(F.col("errors") <= 2, "warn").otherwise("bad"))


@query("a16_top_bucket", f"WITH {METRICS_SQL}, s AS (SELECT signal, bucket, CAST(sum(n) AS BIGINT) AS total FROM metrics GROUP BY ALL) SELECT signal, bucket, total FROM s QUALIFY row_number() OVER (PARTITION BY signal ORDER BY total DESC, bucket DESC) = 1")
def top_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest bucket of each signal, by an aggregate and no window."""
    s = metrics(spark, sf_dir).groupBy("signal", "bucket").agg(F.sum("n").alias("total"))
    return s.groupBy("signal").agg(F.max(F.struct("total", "bucket")).alias("m")).select("signal", "m.bucket", "m.total")


@query("a17_rollup", f"WITH {USERS_SQL}, {AS_OF_SQL} SELECT signal, bucket, days, count(DISTINCT CASE WHEN date >= d - days + 1 THEN install_id END) AS users FROM metric_users, as_of, (SELECT unnest([7, 14, 30]) AS days) GROUP BY ALL")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct installs over three windows at once, from the last day on which each was seen."""
    u = with_as_of(metric_users(spark, sf_dir), spark, sf_dir)
    last = u.groupBy("signal", "bucket", "install_id").agg(F.max("date").alias("last"), F.first("as_of").alias("as_of"))
    counts = last.groupBy("signal", "bucket").agg(*(F.count_if(F.col("last") >= F.date_sub("as_of", n - 1)).alias(str(n)) for n in (7, 14, 30)))
    return counts.unpivot(["signal", "bucket"], ["7", "14", "30"], "days", "users").withColumn("days", F.col("days").cast("int"))


@query("a18_staleness", "SELECT event_type AS signal, min(m) AS oldest FROM (SELECT event_type, user_id, max(CAST(ts AS DATE)) AS m FROM events GROUP BY ALL) GROUP BY 1", dates=("oldest",))
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest of the latest updates."""
    last = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max("date").alias("m"))
    return last.groupBy(F.col("event_type").alias("signal")).agg(F.min("m").alias("oldest"))


@query("a32_running_total", "SELECT date, n, CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS total FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)", dates=("date",))
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative series. The window stands over one row a day, after the aggregate."""
    d = events(spark, sf_dir).where("event_type = 'signup'").groupBy("date").agg(F.count("*").alias("n"))
    return d.withColumn("total", F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


@query("a33_posting_caps", "WITH m AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id, count(*) AS n, any_value(user_id % 3) AS trust FROM events, m WHERE ts > now - INTERVAL 24 HOUR GROUP BY user_id) SELECT user_id, n, CASE trust WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END AS cap, n >= CASE trust WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 10 END AS blocked FROM c")
def posting_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the last 24 hours against a cap that depends on trust."""
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    c = e.join(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 24 HOURS")).groupBy("user_id").agg(F.count("*").alias("n"))
    cap = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, 3).otherwise(10)
    return c.withColumn("cap", cap).withColumn("blocked", F.col("n") >= F.col("cap"))


@query("a34_flag_threshold", "SELECT l_partkey, count(DISTINCT l_suppkey) AS reporters, CASE WHEN count(DISTINCT l_suppkey) >= 4 THEN 'hidden' ELSE 'visible' END AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey")
def flag_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden once four different reporters flagged it."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("reporters"))
    return r.withColumn("status", F.when(F.col("reporters") >= 4, "hidden").otherwise("visible"))


# Joins


@query("j01_inner_dimensions", "SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def inner_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their dimensions; aggregated before the names are looked up."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, "n_nationkey").select("n_name", "r_name", "suppliers")


@query("j02_left_default", "SELECT o_orderkey, coalesce(c_name, 'deleted') AS author FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey")
def left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author, or a default where there is none any more."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("deleted")).alias("author"))


@query("j03_trending", "WITH w AS (SELECT max(l_shipdate) AS m FROM lineitem), t AS (SELECT l_partkey, count(*) AS c FROM lineitem, w WHERE l_shipdate > m - INTERVAL 7 DAY GROUP BY l_partkey) SELECT p_partkey, coalesce(c, 0) AS trend, p_size FROM part LEFT JOIN t ON p_partkey = l_partkey ORDER BY trend DESC, p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages by the installs of the last week, a page of them."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    last = line.agg(F.max("l_shipdate").alias("m"))
    trend = line.join(F.broadcast(last)).where(F.col("l_shipdate") > F.col("m") - F.expr("INTERVAL 7 DAYS")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("c"))
    out = table(spark, sf_dir, "part").select("p_partkey", "p_size").join(trend, "p_partkey", "left").select("p_partkey", F.coalesce("c", F.lit(0)).alias("trend"), "p_size")
    return out.orderBy(F.desc("trend"), F.desc("p_size"), "p_partkey").offset(5).limit(20)


@query("j04_feed", "SELECT event_id, event_type, c_name FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 30")
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest events of some types with their subject; cut before they are joined, as the join keeps every row."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).orderBy(F.desc("ts"), F.desc("event_id")).limit(30)
    return e.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "event_type", "c_name")


@query("j05_scalar_subqueries", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS topics, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top_balance FROM nation")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count and a maximum for each category, from one aggregate."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("topics"), F.max("c_acctbal").alias("top_balance"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_name", F.coalesce("topics", F.lit(0)).alias("topics"), "top_balance")


@query("j06_exists_flag", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END AS liked FROM customer")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is any, as 0 or 1."""
    has = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("liked", F.lit(1))
    return table(spark, sf_dir, "customer").select("c_custkey").join(has, "c_custkey", "left").select("c_custkey", F.coalesce("liked", F.lit(0)).alias("liked"))


@query("j07_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nothing holds."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("w01_sample_retention", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS z FROM events WHERE event_type = 'error') SELECT event_id, user_id FROM r WHERE a <= 1 OR z <= 5")
def sample_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the five latest samples of each group."""
    return series.first_and_latest(table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], "event_id", 1, 5).select("event_id", "user_id")


@query("u01_kept_ids", "WITH e AS (SELECT * FROM events WHERE event_type = 'error'), f AS (SELECT min(event_id) AS id FROM e GROUP BY user_id), l AS (SELECT max(event_id) AS id FROM e GROUP BY user_id) SELECT id FROM f UNION SELECT id FROM l")
def kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last ids as one set."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("z"))
    return e.select(F.explode(F.array_distinct(F.array("a", "z"))).alias("id")).distinct()


@query("j08_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to delete: those that are not kept."""
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


# Order


@query("t05_priority_order", "WITH g AS (SELECT user_id, count(*) AS n, max(value) AS worst, CASE WHEN max(value) > 60 THEN 'critical' WHEN max(value) > 15 THEN 'high' ELSE 'low' END AS severity FROM events WHERE event_type = 'error' GROUP BY user_id), top AS (SELECT * FROM g ORDER BY n DESC, user_id LIMIT 50) SELECT user_id, n, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, n DESC, user_id) AS place FROM top")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, P10: the fifty largest groups first, and these by severity."""
    g = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("worst"))
    g = g.withColumn("severity", F.when(F.col("worst") > 60, "critical").when(F.col("worst") > 15, "high").otherwise("low"))
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).otherwise(2)
    top = g.orderBy(F.desc("n"), "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("n"), "user_id"))).select("user_id", "n", "severity", "place")  # over fifty rows


@query("t07_forum_order", "SELECT o_orderkey, o_orderpriority = '1-URGENT' AS pinned, o_orderdate FROM orders ORDER BY pinned DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def forum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned topics first, then the latest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), "o_orderdate")
    return o.orderBy(F.desc("pinned"), F.desc("o_orderdate"), "o_orderkey").limit(50)


@query("t10_pending_cap", "WITH m AS (SELECT max(ts) AS now FROM events), p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events, m WHERE event_type = 'error' AND ts >= now - INTERVAL 14 DAY) SELECT event_id FROM p WHERE rn <= 64")
def pending_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing older than 14 days, and the newest 64 of the rest."""
    e = table(spark, sf_dir, "events")
    young = e.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where((F.col("event_type") == "error") & (F.col("ts") >= F.col("now") - F.expr("INTERVAL 14 DAYS")))
    return young.orderBy(F.desc("ts"), F.desc("event_id")).limit(64).select("event_id")


@query("t11_visible_facets", "WITH c AS (SELECT user_id % 20 AS facet, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, facet) AS rn FROM c) SELECT facet, n, rn FROM r WHERE rn <= 5 OR facet = 13")
def visible_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five facets, and the active one."""
    c = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("facet")).agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "facet"))).where("rn <= 5 or facet = 13")  # one row a facet


# Ingest and filters


@query("d09_ingest_sentinel", f"WITH {AS_OF_SQL}, t AS (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE CAST(ts AS DATE) < d) AS checkpoint FROM events, as_of GROUP BY event_type) SELECT event_type, total, checkpoint, total <= checkpoint AS stalled FROM t")
def ingest_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals against those of the last checkpoint."""
    e = with_as_of(events(spark, sf_dir), spark, sf_dir)
    t = e.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("date") < F.col("as_of")).alias("checkpoint"))
    return t.withColumn("stalled", F.col("total") <= F.col("checkpoint"))


@query("p02_optional_filters", f"WITH b AS (SELECT event_id, event_type, {BUCKET_SQL} AS bucket, 'os' || (user_id % 3) || ' ' || 'arch' || (user_id % 2) AS platform FROM events) SELECT event_id, event_type, bucket, platform FROM b WHERE event_type = 'error' AND platform = 'os1 arch1'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that are only there if asked for; empty and ``all`` mean any."""
    e = table(spark, sf_dir, "events").withColumn("bucket", value_bucket()).withColumn("platform", F.concat_ws(" ", F.concat(F.lit("os"), F.col("user_id") % 3), F.concat(F.lit("arch"), F.col("user_id") % 2)))
    return series.where_given(e, event_type="error", platform="os1 arch1", bucket="all").select("event_id", "event_type", "bucket", "platform")


@query("t_top_latest_versions", "WITH v AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, rn FROM v WHERE rn <= 2")
def top_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest rows of each key."""
    return top_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id", "rn")
