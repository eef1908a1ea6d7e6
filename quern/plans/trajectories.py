"""Event streams of runs: pairing, rounds, streaks, intervals, percentiles, arms and Pareto fronts.

A run is a user's events in time; ``view`` is a dispatch, ``click`` a result, ``error`` a
retry, ``signup`` the start of a turn, ``purchase`` a passed check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import intervals, series
from quern.plans.registry import query
from quern.sources.tables import table

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_MS = "(epoch_us(ts) // 1000)"
LAYERS = ["view", "error", "click", "signup"]


def in_run():
    """The window over a run in the order of its events."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an interval of ``value`` minutes, in milliseconds."""
    e = runs(spark, sf_dir)
    return e.select("user_id", "event_type", F.col("ms").alias("start"), (F.col("ms") + F.round(F.col("value") * 100).cast("bigint") * 600).alias("end"))


_SPANS_SQL = f"spans AS (SELECT user_id, event_type, {_MS} AS s, ({_MS}) + CAST(round(value * 100) AS BIGINT) * 600 AS e FROM events)"
_MERGED_SQL = """g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM spans WHERE e > s),
h AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g),
merged AS (SELECT user_id, k, min(s) AS s, max(e) AS e FROM h GROUP BY user_id, k)"""


@query("i01_merge", f'WITH {_SPANS_SQL}, {_MERGED_SQL} SELECT user_id, s AS "start", e AS "end" FROM merged')
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that touch or overlap as one."""
    return intervals.merge(spans(spark, sf_dir), ["user_id"])


@query("i02_union_length", f"WITH {_SPANS_SQL}, {_MERGED_SQL} SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY user_id")
def union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that any interval covers."""
    return intervals.union_length(spans(spark, sf_dir), ["user_id"])


@query("i03_span_overlap", f"WITH {_SPANS_SQL}, o AS (SELECT *, coalesce(s < max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS o FROM spans) SELECT user_id, max(e) - min(s) AS span, bool_or(o) AS overlap FROM o GROUP BY user_id")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first start to the last end, and whether two overlap."""
    return intervals.overlaps(spans(spark, sf_dir), ["user_id"])


_SWEEP_SQL = """p AS (SELECT user_id, event_type, s AS a, 1 AS d FROM spans UNION ALL SELECT user_id, event_type, e, -1 FROM spans),
st AS (SELECT user_id, a, {steps} FROM p GROUP BY user_id, a),
seg AS (SELECT user_id, a, lead(a) OVER w AS b, {opens} FROM st WINDOW w AS (PARTITION BY user_id ORDER BY a))"""


def _sweep_sql(layers: list[str]) -> str:
    return _SWEEP_SQL.format(steps=", ".join(f"sum(CASE WHEN event_type = '{x}' THEN d ELSE 0 END) AS d_{x}" for x in layers), opens=", ".join(f"sum(d_{x}) OVER w AS o_{x}" for x in layers))


@query("i04_subtract", f"WITH {_SPANS_SQL}, {_sweep_sql(['view', 'error'])} SELECT user_id, CAST(sum(b - a) AS BIGINT) AS ms FROM seg WHERE o_view > 0 AND o_error = 0 AND b IS NOT NULL GROUP BY user_id")
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: dispatch time that no retry covers."""
    s = spans(spark, sf_dir)
    left = intervals.subtract(s.where("event_type = 'view'"), s.where("event_type = 'error'"), ["user_id"])
    return left.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("ms"))


@query("i05_wall_decomposition", f"WITH {_SPANS_SQL}, {_sweep_sql(LAYERS)}, f AS (SELECT user_id, b - a AS ms, CASE WHEN o_view > 0 THEN 'view' WHEN o_error > 0 THEN 'error' WHEN o_click > 0 THEN 'click' WHEN o_signup > 0 THEN 'signup' ELSE 'other' END AS l FROM seg WHERE b IS NOT NULL) SELECT user_id, " + ", ".join(f"CAST(sum(CASE WHEN l = '{x}' THEN ms ELSE 0 END) AS BIGINT) AS {x}" for x in [*LAYERS, "other"]) + " FROM f GROUP BY user_id")
def wall_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each moment of a run to the first kind of work that is open in it."""
    return intervals.by_priority(spans(spark, sf_dir), ["user_id"], "event_type", LAYERS)


@query("i06_parallel_savings", f"WITH {_SPANS_SQL}, {_MERGED_SQL}, c AS (SELECT user_id, sum(e - s) AS covered FROM merged GROUP BY user_id), t AS (SELECT user_id, sum(e - s) AS total FROM spans GROUP BY user_id) SELECT user_id, CAST(total - covered AS BIGINT) AS saved FROM c JOIN t USING (user_id)")
def parallel_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that was saved by doing things at once."""
    s = spans(spark, sf_dir)
    total = s.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    return intervals.union_length(s, ["user_id"]).join(total, "user_id").select("user_id", (F.col("total") - F.col("covered")).alias("saved"))


@query("j13_as_of", f"WITH c AS (SELECT user_id, ts, event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER {_W} AS checkpoint FROM events) SELECT event_id, checkpoint FROM c WHERE event_type = 'error'")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the last checkpoint before it, in one pass over the sorted run."""
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(in_run())
    return runs(spark, sf_dir).withColumn("checkpoint", last).where("event_type = 'error'").select("event_id", "checkpoint")


@query("j14_pairing", f"WITH p AS (SELECT event_id, event_type, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS nt, {_MS} AS a, lead({_MS}) OVER w AS b FROM events WHERE event_type IN ('view', 'click') WINDOW w AS {_W}) SELECT event_id AS dispatch, nxt AS result, b - a AS ms FROM p WHERE event_type = 'view' AND nt = 'click'")
def pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dispatch with the result that follows it."""
    p = runs(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    p = p.select("event_type", F.col("event_id").alias("dispatch"), F.lead("event_id").over(in_run()).alias("result"), F.lead("event_type").over(in_run()).alias("nt"), (F.lead("ms").over(in_run()) - F.col("ms")).alias("ms"))
    return p.where("event_type = 'view' and nt = 'click'").select("dispatch", "result", "ms")


@query("w03_regressions", f"WITH c AS (SELECT user_id, event_id, event_type = 'purchase' AS pass, max(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WHERE event_type IN ('purchase', 'error')) SELECT user_id, count(*) FILTER (WHERE NOT pass AND before) AS regressed, min(CASE WHEN pass THEN event_id END) AS first_pass FROM c GROUP BY user_id")
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass, and failures after one."""
    c = runs(spark, sf_dir).where(F.col("event_type").isin("purchase", "error")).withColumn("pass", F.col("event_type") == "purchase")
    c = c.withColumn("before", F.max("pass").over(in_run().rowsBetween(Window.unboundedPreceding, -1)))
    return c.groupBy("user_id").agg(F.count_if(~F.col("pass") & F.col("before")).alias("regressed"), F.min(F.when(F.col("pass"), F.col("event_id"))).alias("first_pass"))


@query("w04_harmful", f"WITH c AS (SELECT event_id, event_type, lag(event_type) OVER {_W} AS prev FROM events WHERE event_type IN ('purchase', 'error')) SELECT event_id FROM c WHERE event_type = 'error' AND prev = 'purchase'")
def harmful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from a pass to a failure."""
    c = runs(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return c.withColumn("prev", F.lag("event_type").over(in_run())).where("event_type = 'error' and prev = 'purchase'").select("event_id")


@query("w05_streaks", f"WITH r AS (SELECT user_id, event_type, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, event_type, k, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest FROM s WHERE event_type = 'view' GROUP BY user_id")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of one kind of event."""
    e = series.islands(runs(spark, sf_dir).withColumn("prev", F.lag("event_type").over(in_run())), ["user_id"], ["ts", "event_id"], F.coalesce(F.col("prev") != F.col("event_type"), F.lit(True)))
    n = e.where("event_type = 'view'").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.max("n").alias("longest"))


_STEP = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


def step():
    return F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)


@query("w06_running_best", f"WITH r AS (SELECT *, CAST(sum({_STEP}) OVER {_W} AS BIGINT) AS score FROM events), b AS (SELECT *, max(score) OVER {_W} AS best FROM r) SELECT user_id, max(best) AS best, arg_min(event_id, struct_pack(a := -score, b := ts, c := event_id)) AS best_at, CAST(max(best) - arg_max(score, struct_pack(a := ts, b := event_id)) AS BIGINT) AS regret FROM b GROUP BY user_id")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running score, its best value and when it was first reached, and what was lost since."""
    r = runs(spark, sf_dir).withColumn("score", F.sum(step()).over(in_run()))
    g = r.groupBy("user_id").agg(F.max("score").alias("best"), F.min_by("event_id", F.struct((-F.col("score")).alias("a"), "ts", "event_id")).alias("best_at"), F.max_by("score", F.struct("ts", "event_id")).alias("last"))
    return g.select("user_id", "best", "best_at", (F.col("best") - F.col("last")).alias("regret"))


@query("w07_look_ahead", f"WITH r AS (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS redeemed FROM events) SELECT event_id, redeemed FROM r WHERE event_type = 'error'")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an objective is met within the next three steps."""
    soon = F.max((F.col("event_type") == "purchase").cast("int")).over(in_run().rowsBetween(0, 3))
    return runs(spark, sf_dir).withColumn("redeemed", soon).where("event_type = 'error'").select("event_id", "redeemed")


@query("w08_first_markers", f"SELECT user_id, min(CASE WHEN event_type = 'view' THEN {_MS} END) - min({_MS}) AS to_first_view, min(CASE WHEN event_type = 'purchase' THEN {_MS} END) - min({_MS}) AS to_first_pass FROM events GROUP BY user_id")
def first_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long until the first of some kinds."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ms")))
    return runs(spark, sf_dir).groupBy("user_id").agg((first("view") - F.min("ms")).alias("to_first_view"), (first("purchase") - F.min("ms")).alias("to_first_pass"))


@query("w09_duplicates", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the run has made before with the same arguments."""
    w = Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn > 1").select("event_id")


@query("w10_gaps", f"WITH r AS (SELECT event_id, event_type, {_MS} - lag({_MS}) OVER {_W} AS gap FROM events) SELECT event_id, gap FROM r WHERE event_type = 'view' AND gap IS NOT NULL")
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time between a dispatch and what was before it."""
    return runs(spark, sf_dir).withColumn("gap", F.col("ms") - F.lag("ms").over(in_run())).where("event_type = 'view' and gap is not null").select("event_id", "gap")


@query("w11_cutoff", "WITH c AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN ts END) AS cut FROM events GROUP BY user_id) SELECT user_id, count(*) FILTER (WHERE cut IS NULL OR ts <= cut) AS before_n, count(*) FILTER (WHERE ts > cut) AS after_n FROM events JOIN c USING (user_id) GROUP BY user_id")
def cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps before and after the first pass."""
    e = runs(spark, sf_dir).withColumn("cut", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("cut").isNull() | (F.col("ts") <= F.col("cut"))).alias("before_n"), F.count_if(F.col("ts") > F.col("cut")).alias("after_n"))


@query("w13_flips", "WITH f AS (SELECT user_id, event_type IN ('purchase') AS ok, lag(event_type IN ('purchase')) OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('purchase', 'error')) SELECT user_id, count(*) FILTER (WHERE ok AND prev = false) AS gained, count(*) FILTER (WHERE NOT ok AND prev) AS lost FROM f GROUP BY user_id")
def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that went from failing to passing and back; a first sighting is neither."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error")).withColumn("key", F.get_json_object("props", "$.k").cast("bigint") % 5)
    w = Window.partitionBy("user_id", "key").orderBy("ts", "event_id")
    f = e.withColumn("ok", F.col("event_type") == "purchase").withColumn("prev", F.lag("ok").over(w))
    return f.groupBy("user_id").agg(F.count_if(F.col("ok") & (F.col("prev") == F.lit(False))).alias("gained"), F.count_if(~F.col("ok") & F.col("prev")).alias("lost"))


@query("w14_debt_age", f"WITH r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER {_W} AS isl FROM events), d AS (SELECT event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS debt FROM r) SELECT event_id, CAST(debt AS BIGINT) AS debt FROM d")
def debt_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes since the last check that settled them."""
    r = series.islands(runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "isl")
    w = Window.partitionBy("user_id", "isl").orderBy("ts", "event_id")
    return r.withColumn("debt", F.sum((F.col("event_type") == "error").cast("int")).over(w)).select("event_id", "debt")


@query("w15_novelty", "SELECT user_id, count(*) AS novel FROM (SELECT user_id, event_type, props FROM events GROUP BY ALL) GROUP BY user_id")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different actions a run has seen."""
    return table(spark, sf_dir, "events").select("user_id", "event_type", "props").distinct().groupBy("user_id").agg(F.count("*").alias("novel"))


@query("w16_display_index", "SELECT conv_id, turn, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS authored FROM conversations")
def display_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each message begins, and how many turns were authored up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    offset = F.coalesce(F.sum(F.octet_length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", offset.cast("bigint").alias("byte_offset"), F.count(F.when(F.col("role") == "user", 1)).over(w).alias("authored"))


@query("e04_rounds", f"WITH r AS (SELECT user_id, event_type, CASE WHEN event_type = 'view' AND coalesce(lag(event_type) OVER {_W}, '') <> 'view' THEN 1 ELSE 0 END AS st, ts, event_id FROM events WHERE event_type IN ('view', 'click')), b AS (SELECT *, sum(st) OVER {_W} AS round FROM r) SELECT user_id, CAST(round AS BIGINT) AS round, count(*) FILTER (WHERE event_type = 'view') AS dispatched, count(*) FILTER (WHERE event_type = 'click') AS results FROM b WHERE round > 0 GROUP BY user_id, round")
def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round begins with the first dispatch after a result."""
    r = runs(spark, sf_dir).where(F.col("event_type").isin("view", "click")).withColumn("prev", F.lag("event_type").over(in_run()))
    b = series.islands(r, ["user_id"], ["ts", "event_id"], (F.col("event_type") == "view") & (F.coalesce("prev", F.lit("")) != "view"), "round")
    return b.where("round > 0").groupBy("user_id", "round").agg(F.count_if(F.col("event_type") == "view").alias("dispatched"), F.count_if(F.col("event_type") == "click").alias("results"))


# Rounds of fifty events; a call is a view, click or purchase, and what it is called follows from its argument.
_CALL_SQL = "c AS (SELECT user_id, event_id // 50 AS batch, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type IN ('view', 'click', 'purchase') AS call, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS dup FROM events)"
_FLAGS_SQL = """g AS (SELECT user_id, batch, bool_or(event_type = 'error' AND value > 80) AS tainted, bool_or(event_type = 'signup' AND k < 10) AS compaction, bool_or(event_type = 'signup') AS planner, bool_or(event_type = 'error' AND k < 20) AS handoff,
  bool_or(call) AS batch_there, bool_or(call AND k = 7) AS delegation, bool_or(event_type = 'purchase') AS verification, bool_or(event_type = 'click' AND k % 5 <> 0 AND value < 60) AS mutation, bool_and(NOT call OR (event_type = 'click' AND k % 5 = 0)) AS bookkeeping, bool_and(NOT call OR dup) AS dups,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS ms FROM c GROUP BY user_id, batch)"""
_CLASS_SQL = "cl AS (SELECT *, CASE WHEN tainted THEN 'recovery' WHEN compaction THEN 'compaction' WHEN planner THEN 'planning' WHEN handoff THEN 'handoff_retry' WHEN NOT batch_there THEN 'finalization' WHEN delegation THEN 'delegation' WHEN verification THEN 'verification' WHEN mutation THEN 'mutation' WHEN bookkeeping THEN 'bookkeeping' WHEN dups THEN 'duplicate_work' ELSE 'evidence_gain' END AS class FROM g)"
#: Rounds that move a task forward.
PRODUCTIVE = ["evidence_gain", "mutation", "verification", "finalization", "delegation"]


def classified_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, class, ms) of each round: what happened in the gap before it outranks what its calls did, and a round without calls is a final answer."""
    call, k = F.col("event_type").isin("view", "click", "purchase"), F.col("k")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    e = e.withColumn("dup", F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")) > 1)
    of, some, every = (lambda t: F.col("event_type") == t), F.bool_or, F.bool_and
    g = e.groupBy("user_id", F.floor(F.col("event_id") / 50).alias("batch")).agg(
        some(of("error") & (F.col("value") > 80)).alias("tainted"), some(of("signup") & (k < 10)).alias("compaction"), some(of("signup")).alias("planner"), some(of("error") & (k < 20)).alias("handoff"), some(call).alias("there"),
        some(call & (k == 7)).alias("delegation"), some(of("purchase")).alias("verification"), some(of("click") & (k % 5 != 0) & (F.col("value") < 60)).alias("mutation"),
        every(~call | (of("click") & (k % 5 == 0))).alias("bookkeeping"), every(~call | F.col("dup")).alias("dups"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("ms"),
    )
    ladder = [("tainted", "recovery"), ("compaction", "compaction"), ("planner", "planning"), ("handoff", "handoff_retry"), (~F.col("there"), "finalization"), ("delegation", "delegation"), ("verification", "verification"), ("mutation", "mutation"), ("bookkeeping", "bookkeeping"), ("dups", "duplicate_work")]
    kind = reduce(lambda rest, x: F.when(F.col(x[0]) if isinstance(x[0], str) else x[0], x[1]).otherwise(rest), reversed(ladder), F.lit("evidence_gain"))
    return g.select("user_id", "batch", kind.alias("class"), "ms")


@query("f30_round_classes", f"WITH {_CALL_SQL}, {_FLAGS_SQL}, {_CLASS_SQL} SELECT class, count(*) AS n FROM cl GROUP BY 1")
def round_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many rounds bought what, in eleven classes."""
    return classified_rounds(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query(
    "a29_round_efficiency",
    f"WITH {_CALL_SQL}, {_FLAGS_SQL}, {_CLASS_SQL}, s AS (SELECT count(DISTINCT user_id) AS solved FROM events WHERE event_type = 'purchase' AND value > 50) SELECT class, count(*) AS rounds, CAST(sum(ms) AS BIGINT) AS ms, list_contains({PRODUCTIVE!r}, class) AS useful, CAST(sum(ms) AS BIGINT) // any_value(solved) AS ms_per_solved, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM cl, s GROUP BY class",
)
def round_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds and time by class, which classes were useful, and what a solved run pays for each; the totals are one row."""
    by = classified_rounds(spark, sf_dir).groupBy("class").agg(F.count("*").alias("rounds"), F.sum("ms").alias("ms"))
    total = by.agg(F.sum("rounds").alias("all_rounds"))
    solved = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 50").agg(F.countDistinct("user_id").alias("solved"))
    out = by.join(F.broadcast(total)).join(F.broadcast(solved))
    return out.select("class", "rounds", "ms", F.col("class").isin(PRODUCTIVE).alias("useful"), F.expr("ms div solved").alias("ms_per_solved"), F.round(F.lit(100.0) * F.col("rounds") / F.col("all_rounds"), 6).alias("pct"))


# Arms: results by order priority, classes by market segment.


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("arm"), F.col("c_mktsegment").alias("class"), (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_orderkey") % 3).alias("attempt"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("wall_ms"), (F.col("o_orderkey") % 17 == 0).alias("unaccounted"),
    )


_RESULTS_SQL = "results AS (SELECT o_orderkey AS task, o_orderpriority AS arm, c_mktsegment AS class, o_orderstatus = 'F' AS passed, o_orderkey % 3 AS attempt, CAST(round(o_totalprice * 100) AS BIGINT) AS wall_ms, o_orderkey % 17 = 0 AS unaccounted FROM orders JOIN customer ON o_custkey = c_custkey)"
_ARM_SQL = "SELECT {key}, count(*) FILTER (WHERE attempt <= 1) AS ran, count(*) FILTER (WHERE attempt <= 1 AND passed) AS pass_1, count(*) FILTER (WHERE passed) AS solved, CAST(coalesce(sum(CASE WHEN NOT unaccounted THEN wall_ms END), 0) AS BIGINT) AS wall_ms, round(sum(CASE WHEN NOT unaccounted THEN wall_ms END) / CAST(nullif(count(*) FILTER (WHERE passed AND NOT unaccounted), 0) AS DOUBLE), 6) AS per_solved FROM results GROUP BY {key}"


def arms(r: DataFrame, *keys: str) -> DataFrame:
    booked = F.sum(F.when(~F.col("unaccounted"), F.col("wall_ms")))
    return r.groupBy(*keys).agg(
        F.count_if(F.col("attempt") <= 1).alias("ran"), F.count_if((F.col("attempt") <= 1) & F.col("passed")).alias("pass_1"), F.count_if("passed").alias("solved"),
        F.coalesce(booked, F.lit(0)).alias("wall_ms"), F.round(booked / F.nullif(F.count_if(F.col("passed") & ~F.col("unaccounted")), F.lit(0)), 6).alias("per_solved"),
    )


@query("a19_arms", f"WITH {_RESULTS_SQL} {_ARM_SQL.format(key='arm')}")
def arm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts, solved tasks and time of each arm; time that was not accounted is left out of it."""
    return arms(results(spark, sf_dir), "arm")


@query("a19_arm_classes", f"WITH {_RESULTS_SQL} {_ARM_SQL.format(key='arm, class')}")
def arm_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by class of task."""
    return arms(results(spark, sf_dir), "arm", "class")


_CELL_SQL = "CASE WHEN count(*) FILTER (WHERE arm = '{0}') = 0 THEN '—' ELSE count(*) FILTER (WHERE arm = '{0}' AND passed) || '/' || count(*) FILTER (WHERE arm = '{0}') END AS {1}"
ARMS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query("j17_matrix", f"WITH {_RESULTS_SQL} SELECT class, " + ", ".join(_CELL_SQL.format(a, b) for a, b in ARMS.items()) + " FROM results WHERE arm <> '3-MEDIUM' OR class <> 'BUILDING' GROUP BY class")
def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms as columns, classes as rows, with solved and run tasks; a dash where an arm has not run a class (here one is left out)."""
    r = results(spark, sf_dir).where("arm <> '3-MEDIUM' or class <> 'BUILDING'")
    p = r.groupBy("class").pivot("arm", list(ARMS)).agg(F.count_if("passed").alias("solved"), F.count(F.lit(1)).alias("ran"))
    cell = lambda a: F.when(F.coalesce(F.col(f"`{a}_ran`"), F.lit(0)) == 0, "—").otherwise(F.concat_ws("/", F.col(f"`{a}_solved`").cast("string"), F.col(f"`{a}_ran`").cast("string")))
    return p.select("class", *(cell(a).alias(b) for a, b in ARMS.items()))


@query("a20_upper_median", f"WITH {_RESULTS_SQL} SELECT arm, class, list_sort(list(wall_ms))[count(*) // 2 + 1] AS median_ms FROM results WHERE passed GROUP BY arm, class")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper of the two middle values, from counts by value."""
    return series.upper_median(results(spark, sf_dir).where("passed"), ["arm", "class"], "wall_ms").select("arm", "class", F.col("median").alias("median_ms"))


@query("a21_percentiles", f"WITH {_RESULTS_SQL} SELECT arm, quantile_disc(wall_ms, 0.5) AS p50, quantile_disc(wall_ms, 0.9) AS p90, quantile_disc(wall_ms, 0.95) AS p95 FROM results GROUP BY arm")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles, exact, from counts by value."""
    return series.percentiles(results(spark, sf_dir), ["arm"], "wall_ms", {"p50": 50, "p90": 90, "p95": 95}).select("arm", "p50", "p90", "p95")


@query("a23_rates", f"WITH {_RESULTS_SQL} SELECT arm, round(count(*) FILTER (WHERE passed) * 3600000.0 / sum(wall_ms), 6) AS solved_per_hour, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 6) AS solved_pct FROM results GROUP BY arm")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solved tasks for an hour, and their share."""
    return results(spark, sf_dir).groupBy("arm").agg(F.round(F.count_if("passed") * F.lit(3600000.0) / F.sum("wall_ms"), 6).alias("solved_per_hour"), F.round(F.lit(100.0) * F.count_if("passed") / F.count("*"), 6).alias("solved_pct"))


@query("a24_failures", f"WITH {_RESULTS_SQL} SELECT CASE WHEN passed THEN 'none' WHEN wall_ms > 30000000 THEN 'timeout' WHEN attempt > 1 THEN 'gave_up' ELSE 'wrong' END AS failure, count(*) AS n FROM results GROUP BY 1")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why tasks failed, by the first reason that holds."""
    why = F.when(F.col("passed"), "none").when(F.col("wall_ms") > 30000000, "timeout").when(F.col("attempt") > 1, "gave_up").otherwise("wrong")
    return results(spark, sf_dir).groupBy(why.alias("failure")).agg(F.count("*").alias("n"))


MECHANISMS = ["error", "signup", "click", "view"]


@query(
    "a26_mechanisms",
    f"WITH u AS (SELECT user_id, event_type, count(*) AS fires, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS ms FROM events GROUP BY ALL), s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 20 THEN 1 ELSE 0 END) AS solved FROM events WHERE event_id % 3 = 0 OR event_type <> 'purchase' GROUP BY user_id), m AS (SELECT unnest({MECHANISMS!r}) AS mechanism) SELECT mechanism, CAST(coalesce(sum(fires), 0) AS BIGINT) AS fires, count(*) FILTER (WHERE fires > 0) AS runs_fired, CASE WHEN mechanism <> 'view' THEN CAST(coalesce(sum(ms), 0) AS BIGINT) END AS ms, CAST(coalesce(sum(CASE WHEN fires > 0 THEN solved END), 0) AS BIGINT) AS solved_fired, CAST(coalesce(sum(CASE WHEN fires IS NULL THEN solved END), 0) AS BIGINT) AS solved_quiet FROM s CROSS JOIN m LEFT JOIN u ON u.user_id = s.user_id AND u.event_type = mechanism GROUP BY mechanism",
)
def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mechanism fired, in how many runs, the time that it took where that is known, and runs solved where it fired and where not.

    Counts stand in one row a run and are then turned; a run is solved here by some of its purchases.
    """
    solved = F.max(((F.col("event_type") == "purchase") & (F.col("value") > 20) & (F.col("event_id") % 3 == 0)).cast("int"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    counted = [F.struct(F.count_if(F.col("event_type") == n).alias("fires"), F.sum(F.when(F.col("event_type") == n, cents).otherwise(0)).alias("ms")).alias(n) for n in MECHANISMS]
    any_row = F.count_if((F.col("event_id") % 3 == 0) | (F.col("event_type") != "purchase"))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(solved.alias("solved"), any_row.alias("recorded"), *counted).where("recorded > 0")
    long = g.unpivot(["user_id", "solved"], MECHANISMS, "mechanism", "x").select("mechanism", "solved", "x.fires", "x.ms")
    on = (F.col("fires") > 0).cast("int")
    return long.groupBy("mechanism").agg(F.sum("fires").alias("fires"), F.sum(on).alias("runs_fired"), F.when(F.col("mechanism") != "view", F.sum("ms")).alias("ms"), F.sum(on * F.col("solved")).alias("solved_fired"), F.sum((1 - on) * F.col("solved")).alias("solved_quiet"))


_TREE_SQL = "t AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE never) AS never, count(*) FILTER (WHERE NOT never) AS with_correct, count(*) FILTER (WHERE NOT never AND attempt = 0 AND NOT passed) AS damaged, coalesce(sum(CASE WHEN NOT never THEN wall_ms // 5 * attempt END), 0) AS waste, coalesce(sum(CASE WHEN NOT never THEN wall_ms // 6 END), 0) AS ttfum, sum(wall_ms) AS wall FROM (SELECT *, NOT passed AND attempt > {least} AS never FROM results WHERE NOT unaccounted) GROUP BY arm)"


def diagnosis(never, checkpointed, damaged, with_correct, waste, ttfum):
    """What to work on first: runs that are never right, then runs that were spoilt, then the larger of what is wasted after a solution and before a first use; in whole numbers."""
    return F.when(never * 100 >= checkpointed * 30, "never_correct").when((with_correct > 0) & (damaged * 100 >= with_correct * 10), "damaged").when(waste >= ttfum, "post_solve_waste").otherwise("exploration")


@query(
    "a42_decision_tree",
    f"WITH {_RESULTS_SQL}, {_TREE_SQL.format(least=1)} SELECT arm, CASE WHEN never * 100 >= n * 30 THEN 'never_correct' WHEN with_correct > 0 AND damaged * 100 >= with_correct * 10 THEN 'damaged' WHEN waste >= ttfum THEN 'post_solve_waste' ELSE 'exploration' END AS verdict FROM t WHERE wall > 0",
)
def decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first threshold that the totals of an arm pass; runs that were not accounted are left out."""
    never = ~F.col("passed") & (F.col("attempt") > 1)
    r = results(spark, sf_dir).where(~F.col("unaccounted"))
    t = r.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if(never).alias("never"), F.count_if(~never).alias("with_correct"), F.count_if(~never & (F.col("attempt") == 0) & ~F.col("passed")).alias("damaged"),
        F.coalesce(F.sum(F.when(~never, F.floor(F.col("wall_ms") / 5) * F.col("attempt"))), F.lit(0)).alias("waste"), F.coalesce(F.sum(F.when(~never, F.floor(F.col("wall_ms") / 6))), F.lit(0)).alias("ttfum"), F.sum("wall_ms").alias("wall"),
    )
    return t.where("wall > 0").select("arm", diagnosis(*(F.col(c) for c in ("never", "n", "damaged", "with_correct", "waste", "ttfum"))).alias("verdict"))


@query("j18_pareto", f"WITH {_RESULTS_SQL}, a AS (SELECT class || '/' || arm AS label, count(*) FILTER (WHERE passed) AS solved, count(*) FILTER (WHERE attempt = 0) AS cheap FROM results GROUP BY ALL), d AS (SELECT x.label, min(y.label) AS dominated_by FROM a x JOIN a y ON x.label <> y.label AND y.solved >= x.solved AND y.cheap >= x.cheap AND (y.solved > x.solved OR y.cheap > x.cheap) GROUP BY x.label) SELECT a.label, solved, cheap, dominated_by FROM a LEFT JOIN d USING (label)")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arms another one beats on both counts, and the first that does; over one row an arm."""
    a = results(spark, sf_dir).groupBy(F.concat_ws("/", "class", "arm").alias("label")).agg(F.count_if("passed").alias("solved"), F.count_if(F.col("attempt") == 0).alias("cheap"))
    x, y = a.alias("x"), a.alias("y")
    better = (F.col("x.label") != F.col("y.label")) & (F.col("y.solved") >= F.col("x.solved")) & (F.col("y.cheap") >= F.col("x.cheap")) & ((F.col("y.solved") > F.col("x.solved")) | (F.col("y.cheap") > F.col("x.cheap")))
    d = x.join(y, better).groupBy("x.label").agg(F.min("y.label").alias("dominated_by"))
    return a.join(d, "label", "left").select("label", "solved", "cheap", "dominated_by")


# Logs


@query("e01_coalesce", f"WITH r AS (SELECT user_id, event_type, {_MS} AS ms, ts, event_id, CASE WHEN lag(event_type) OVER {_W} = event_type AND {_MS} - lag({_MS}) OVER {_W} <= 3600000 THEN 0 ELSE 1 END AS st FROM events), b AS (SELECT *, sum(st) OVER {_W} AS k FROM r) SELECT user_id, CAST(k AS BIGINT) AS k, min(event_type) AS kind, count(*) AS n, min(ms) AS first_ms FROM b GROUP BY user_id, k")
def coalesce_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one kind as one, if they are close in time."""
    r = runs(spark, sf_dir).withColumn("prev", F.lag("event_type").over(in_run())).withColumn("gap", F.col("ms") - F.lag("ms").over(in_run()))
    b = series.islands(r, ["user_id"], ["ts", "event_id"], ~F.coalesce((F.col("prev") == F.col("event_type")) & (F.col("gap") <= 3600000), F.lit(False)), "k")
    return b.groupBy("user_id", "k").agg(F.min("event_type").alias("kind"), F.count("*").alias("n"), F.min("ms").alias("first_ms"))


@query("e03_turn_counters", f"WITH t AS (SELECT user_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER {_W} AS turn FROM events) SELECT user_id, CAST(turn AS BIGINT) AS turn, event_type, count(*) AS n FROM t WHERE turn > 0 GROUP BY ALL")
def turn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that start again with every turn."""
    t = series.islands(runs(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "turn")
    return t.where("turn > 0").groupBy("user_id", "turn", "event_type").agg(F.count("*").alias("n"))


@query("e05_replay", "WITH b AS (SELECT conv_id, max(CASE WHEN role = 'system' OR turn = 0 THEN turn END) AS base FROM conversations GROUP BY conv_id), l AS (SELECT c.*, turn - base AS idx, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS pos FROM conversations c JOIN b ON c.conv_id = b.conv_id AND turn >= base) SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(turn) AS last_turn FROM l WHERE idx = pos GROUP BY conv_id")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the state after the last record that replaces everything, with what was appended without a gap."""
    base = F.max(F.when((F.col("role") == "system") | (F.col("turn") == 0), F.col("turn"))).over(Window.partitionBy("conv_id"))
    c = table(spark, sf_dir, "conversations").withColumn("base", base).where("turn >= base")
    c = c.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).where("turn - base = pos")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.max("turn").alias("last_turn"))


_RECORD_SQL = """r AS (
  SELECT conv_id AS log, turn AS seq, CASE WHEN conv_id % 13 = 4 AND turn = 4 THEN 'fork' WHEN role = 'system' OR turn = 0 OR (conv_id % 5 = 2 AND turn = 4) THEN 'replace' ELSE 'append' END AS kind,
         CASE WHEN conv_id % 7 = 3 AND turn = 3 THEN 99 WHEN conv_id % 5 = 2 AND turn > 4 THEN turn - 4 ELSE turn END AS idx, 1 AS n, strlen(text) AS bytes, CASE WHEN conv_id % 17 = 9 AND turn = 2 THEN 2 ELSE 1 END AS version, NOT (conv_id % 11 = 5 AND turn = 2) AS sound FROM conversations
)"""


@query(
    "e05_bounded_replay",
    f"""WITH {_RECORD_SQL},
p AS (SELECT *, row_number() OVER w AS pos, sum(bytes) OVER (PARTITION BY log) AS log_bytes, max(CASE WHEN kind = 'replace' THEN seq END) OVER w AS base FROM r WINDOW w AS (PARTITION BY log ORDER BY seq)),
h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY log, base ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM p),
y AS (SELECT *, CASE WHEN log_bytes > 6000 THEN 'bytes' WHEN NOT sound THEN 'damaged' WHEN version <> 1 THEN 'unsupported' WHEN pos > 6 THEN 'records' WHEN kind = 'append' AND idx <> held THEN 'damaged' WHEN kind = 'fork' THEN 'unsupported' END AS why FROM h),
s AS (SELECT *, coalesce(min(CASE WHEN why IS NOT NULL THEN pos END) OVER (PARTITION BY log), 1000000) AS stop FROM y),
l AS (SELECT *, pos < stop AND seq >= coalesce(max(CASE WHEN pos < stop THEN base END) OVER (PARTITION BY log), -1) AS live FROM s)
SELECT log, count(*) FILTER (pos < stop) AS records, CAST(coalesce(sum(n) FILTER (live), 0) AS BIGINT) AS messages, CAST(coalesce(sum(bytes) FILTER (live), 0) AS BIGINT) AS bytes, coalesce(max(why) FILTER (pos = stop), 'end') AS reason, max(seq) FILTER (pos = stop) AS stopped_at FROM l GROUP BY log""",
)
def bounded_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: logs read back until a record is damaged or unsupported, or a limit is reached, with the reason."""
    from quern.operators.replay import replay

    own = lambda of, is_, turn: (F.col("conv_id") % of == is_) & (F.col("turn") == turn)
    kind = F.when(own(13, 4, 4), "fork").when((F.col("role") == "system") | (F.col("turn") == 0) | own(5, 2, 4), "replace").otherwise("append")
    idx = F.when(own(7, 3, 3), 99).when((F.col("conv_id") % 5 == 2) & (F.col("turn") > 4), F.col("turn") - 4).otherwise(F.col("turn"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("log"), F.col("turn").alias("seq"), kind.alias("kind"), idx.alias("idx"), F.lit(1).alias("n"), F.octet_length("text").alias("bytes"), F.when(own(17, 9, 2), 2).otherwise(1).alias("version"), (~own(11, 5, 2)).alias("sound"))
    return replay(c, 6000, 6)


@query("r11_tail_budget", "WITH t AS (SELECT conv_id, turn, role = 'assistant' AND turn % 4 = 3 AS tool, sum(greatest(length(text), (strlen(text) + 3) // 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS spent, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), s AS (SELECT conv_id, min(turn) AS fits FROM t WHERE spent <= 2000 OR back <= 2 GROUP BY conv_id), b AS (SELECT s.conv_id, coalesce(max(turn) FILTER (NOT tool AND turn <= fits), min(turn)) AS from_turn FROM s JOIN t USING (conv_id) GROUP BY s.conv_id) SELECT conv_id, count(*) AS kept, from_turn FROM b JOIN t USING (conv_id) WHERE turn >= from_turn GROUP BY ALL")
def tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages that fit a budget, and always the last two; more where they would begin with the result of a tool, back to what called it. Every fourth message of a model stands for such a result."""
    from quern.functions.text import token_estimate

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, sf_dir, "conversations").withColumn("spent", F.sum(token_estimate(F.col("text"))).over(w)).withColumn("back", F.row_number().over(w))
    whole = Window.partitionBy("conv_id")
    tool = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    t = t.withColumn("fits", F.min(F.when((F.col("spent") <= 2000) | (F.col("back") <= 2), F.col("turn"))).over(whole))
    t = t.withColumn("from_turn", F.coalesce(F.max(F.when(~tool & (F.col("turn") <= F.col("fits")), F.col("turn"))).over(whole), F.min("turn").over(whole)))
    return t.where("turn >= from_turn").groupBy("conv_id", "from_turn").agg(F.count("*").alias("kept"))
