"""Text scans and hygiene: grep, predicates, redaction, fingerprints, buckets, symbols, diffs by line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import hygiene as H
from quern.functions import text as X
from quern.functions.linediff import tallies
from quern.functions.symbols import declaration, declaration_sql
from quern.operators.series import newest_version
from quern.plans.registry import query
from quern.sources.tables import table

_LINES_SQL = "line AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))


@query("p01_grep", f"WITH {_LINES_SQL} SELECT doc_id, i + 1 AS line_no, left(s, 80) AS found FROM line WHERE regexp_matches(s, 'th[aeiou]nt') ORDER BY doc_id, i LIMIT 200")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two hundred lines that match; texts without a match are dropped before they are cut into lines."""
    hit = table(spark, sf_dir, "documents").where(F.col("text").rlike("th[aeiou]nt"))
    line = hit.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s")).where(F.col("s").rlike("th[aeiou]nt"))
    return line.orderBy("doc_id", "i").limit(200).select("doc_id", (F.col("i") + 1).alias("line_no"), F.left("s", F.lit(80)).alias("found"))


@query("p03_like_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_brand), 'steel') OR contains(lower(p_type), 'steel')")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word in any of several columns, whatever its case."""
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.lower(c).contains("steel")
    return table(spark, sf_dir, "part").where(hit).select("p_partkey")


@query("p05_role_filter", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 20")
def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: messages of the roles that are searched unless others are named."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant") & (F.length("text") > 20)).select("conv_id", "turn", "role")


@query("p08_domain_guards", "SELECT event_id, CASE WHEN value < 0 OR value > 1000 THEN 'reject' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'drop' ELSE 'keep' END AS verdict FROM events")
def domain_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out of range are rejected; unknown signals are dropped."""
    v = F.when((F.col("value") < 0) | (F.col("value") > 1000), "reject").when(~F.col("event_type").isin("view", "click", "purchase"), "drop").otherwise("keep")
    return table(spark, sf_dir, "events").select("event_id", v.alias("verdict"))


@query("p10_severity", "SELECT event_id, CASE WHEN contains(props, '13') THEN 'low' WHEN event_type = 'error' AND value > 60 THEN 'critical' WHEN event_type = 'error' THEN 'high' WHEN value > 60 THEN 'medium' ELSE 'low' END AS severity FROM events")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A severity with an override for reports that tell nothing."""
    error = F.col("event_type") == "error"
    s = F.when(F.col("props").contains("13"), "low").when(error & (F.col("value") > 60), "critical").when(error, "high").when(F.col("value") > 60, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", s.alias("severity"))


@query("p13_newest_version", "WITH v AS (SELECT 'v1.' || (user_id % 12) || '.' || (event_id % 11) AS v FROM events UNION ALL SELECT 'dev' UNION ALL SELECT '9.0.0-rc1') SELECT v AS newest FROM v WHERE regexp_matches(v, '^v?\\d+\\.\\d+\\.\\d+$') ORDER BY CAST(split_part(ltrim(v, 'v'), '.', 1) AS INT) DESC, CAST(split_part(v, '.', 2) AS INT) DESC, CAST(split_part(v, '.', 3) AS INT) DESC, v DESC LIMIT 1")
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest plain version by its numbers."""
    v = table(spark, sf_dir, "events").select(F.concat(F.lit("v1."), F.col("user_id") % 12, F.lit("."), F.col("event_id") % 11).alias("version")).distinct()
    odd = spark.range(1).select(F.explode(F.array(F.lit("dev"), F.lit("9.0.0-rc1"))).alias("version"))
    return newest_version(v.unionByName(odd))


# Capabilities that messages are routed to: (id, kind, policy, triggers, negative triggers). Stronger policies have higher ranks.
RANKS = {"require": 3, "prefer": 2, "suggest": 1}
CAPABILITIES = [
    ("english", "skill", "suggest", ["the ", " and "], []), ("german", "skill", "suggest", [" der ", " und "], []), ("spanish", "skill", "suggest", [" que ", " los "], []), ("french", "skill", "suggest", [" des ", " les "], []),
    ("nation", "tool", "suggest", ["tion"], ["nation"]), ("sender", "tool", "suggest", ["en"], []), ("hotel", "tool", "suggest", ["er"], []), ("notes", "memory", "suggest", ["on"], []),
    ("answers", "skill", "prefer", ["th"], ["thing"]), ("guard", "policy", "require", ["password", "secret"], []),
]
_ROUTES_SQL = ", ".join(f"({c[0]!r}, {c[1]!r}, {RANKS[c[2]]}, {c[3]!r}, CAST({c[4]!r} AS VARCHAR[]))" for c in CAPABILITIES)


@query(
    "p14_routing",
    f"WITH k(capability, kind, rank, yes, no) AS (VALUES {_ROUTES_SQL}), h AS (SELECT conv_id, turn, capability, kind, rank FROM conversations, k WHERE len(list_filter(yes, lambda t: contains(lower(text), t))) > 0 AND len(list_filter(no, lambda t: contains(lower(text), t))) = 0), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank DESC, kind, capability) AS place FROM h) SELECT conv_id, turn, capability, rank, place FROM n WHERE rank >= 2 OR place <= 5",
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capabilities whose triggers a message holds and none of whose negative ones; strong ones all, suggested ones in what is left of five places.

    The capabilities are a short fixed list, so they are tested inside the row and nothing is joined.
    """
    low = F.lower("text")
    any_of = lambda words: reduce(lambda a, t: a | low.contains(t), words, F.lit(False))
    hit = lambda c: F.when(any_of(c[3]) & ~any_of(c[4]), F.struct(F.lit(-RANKS[c[2]]).alias("rank"), F.lit(c[1]).alias("kind"), F.lit(c[0]).alias("capability")))
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(F.array_compact(F.array(*map(hit, CAPABILITIES)))).alias("hits"))
    placed = m.select("conv_id", "turn", F.posexplode("hits").alias("i", "h")).where("i < 5 or h.rank <= -2")
    return placed.select("conv_id", "turn", "h.capability", (-F.col("h.rank")).alias("rank"), (F.col("i") + 1).alias("place"))


_PICK, _DIR_QUOTA, _PICK_LIMIT = "th", 5, 20
_PICK_SQL = "f AS (SELECT rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages), s AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM f)"


@query(
    "p15_file_picker",
    f"WITH {_PICK_SQL}, d AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS path FROM (SELECT p, unnest(range(1, len(p))) AS k FROM s) WHERE contains(lower(p[k]), '{_PICK}')), c AS (SELECT 0 AS tier, path FROM (SELECT path FROM d ORDER BY path LIMIT {_DIR_QUOTA}) UNION ALL SELECT CASE WHEN contains(lower(p[len(p)]), '{_PICK}') THEN 1 ELSE 2 END, path FROM s WHERE contains(lower(path), '{_PICK}')), n AS (SELECT path, tier, row_number() OVER (ORDER BY tier, path) AS place FROM c) SELECT path, tier, place FROM n WHERE place <= {_PICK_LIMIT}",
)
def file_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders (five at most), then files by their names, then by folders above them, until twenty places are filled."""
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), F.lit("/"))
    s = table(spark, sf_dir, "pages").select(path.alias("path")).distinct().withColumn("p", F.split("path", "/"))
    held = lambda x: F.contains(F.lower(x), F.lit(_PICK))
    above = F.filter(F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x, i: F.when(held(x), F.array_join(F.slice("p", F.lit(1), i + 1), "/"))), lambda x: x.isNotNull())
    dirs = s.select(F.explode(above).alias("path")).distinct().orderBy("path").limit(_DIR_QUOTA).select(F.lit(0).alias("tier"), "path")
    tier = lambda k, at: s.where(at).orderBy("path").limit(_PICK_LIMIT).select(F.lit(k).alias("tier"), "path")
    name = held(F.element_at("p", -1))
    found = dirs.unionByName(tier(1, name)).unionByName(tier(2, ~name & held(F.col("path"))))
    return found.withColumn("place", F.row_number().over(Window.orderBy("tier", "path"))).where(F.col("place") <= _PICK_LIMIT).select("path", "tier", "place")  # over 45 rows at most


@query("p17_subsequence", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'a.*e.*l')")
def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold some letters in that order."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").rlike(".*".join("ael"))).select("p_partkey")


_HASH_SQL = "sha256('chunker=3/dims=64' || chr(0) || text)"


@query("j09_sync_actions", f"WITH disk AS (SELECT doc_id, {_HASH_SQL} AS h FROM documents WHERE doc_id % 11 <> 0), state AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE {_HASH_SQL} END AS h FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(d.doc_id, s.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL THEN 'insert' WHEN d.h = s.h THEN 'unchanged' ELSE 'update' END AS action FROM disk d FULL OUTER JOIN state s ON d.doc_id = s.doc_id")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental sync has to do; only ids and digests are shuffled."""
    h = F.sha2(F.concat(F.lit("chunker=3/dims=64"), F.lit("\0"), F.col("text")), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))
    state = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")).alias("was"))
    both = d.where("doc_id % 11 <> 0").join(state, "doc_id", "full_outer")
    action = F.when(F.col("h").isNull(), "delete").when(F.col("was").isNull(), "insert").when(F.col("h") == F.col("was"), "unchanged").otherwise("update")
    return both.select("doc_id", action.alias("action"))


@query("j12_override", "WITH p AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 97) AS title FROM customer WHERE c_nationkey < 5), g AS (SELECT c_custkey AS id, c_mktsegment || (c_custkey % 97) AS title FROM customer) SELECT id, 'project' AS scope FROM p UNION ALL SELECT id, 'global' FROM g WHERE id NOT IN (SELECT id FROM p) AND title NOT IN (SELECT title FROM p)")
def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project facts hide global ones that share any of their keys; keys are exploded, so this is one equi join."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 97).cast("string")).alias("title"), "c_nationkey")
    keys = lambda d: d.select("id", F.explode(F.array(F.concat(F.lit("i:"), F.col("id")), F.concat(F.lit("t:"), F.col("title")))).alias("key"))
    p = c.where("c_nationkey < 5")
    hidden = keys(c).join(keys(p).select("key").distinct(), "key", "left_semi").select("id").distinct()
    return p.select("id", F.lit("project").alias("scope")).unionByName(c.join(hidden, "id", "left_anti").select("id", F.lit("global").alias("scope")))


@query("j16_requirements", "WITH c AS (SELECT s_suppkey AS provider, s_nationkey AS cap, s_suppkey % 5 AS ver FROM supplier), r AS (SELECT c_custkey AS consumer, c_nationkey AS cap, c_custkey % 5 AS least FROM customer), m AS (SELECT consumer, count(provider) AS n, min(provider) AS first_provider FROM r LEFT JOIN c ON r.cap = c.cap AND ver >= least GROUP BY consumer) SELECT consumer, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN first_provider END AS provider FROM m")
def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers of a capability in a sufficient version: none, one or several."""
    c = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("provider"), F.col("s_nationkey").alias("cap"), (F.col("s_suppkey") % 5).alias("ver"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("consumer"), F.col("c_nationkey").alias("cap"), (F.col("c_custkey") % 5).alias("least"))
    # Providers are counted by capability and version before consumers meet them.
    by = c.groupBy("cap", "ver").agg(F.count("*").alias("k"), F.min("provider").alias("p"))
    m = r.join(by, (r["cap"] == by["cap"]) & (by["ver"] >= r["least"]), "left").groupBy("consumer").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.min("p").alias("p"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return m.select("consumer", state.alias("state"), F.when(F.col("n") == 1, F.col("p")).alias("provider"))


@query(
    "j15_late_join",
    "WITH c AS (SELECT user_id, event_type, 'tool' || (CAST(json_extract(props, '$.k') AS BIGINT) % 40) AS tool, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, value FROM events), fold AS (SELECT tool, count(*) AS calls, count(*) FILTER (WHERE nxt = 'click') AS answered FROM c WHERE event_type = 'view' GROUP BY tool), denied AS (SELECT tool, count(*) AS denied FROM c WHERE event_type = 'error' AND value > 60 GROUP BY tool) SELECT tool, calls, answered, coalesce(denied, 0) AS denied FROM fold LEFT JOIN denied USING (tool)",
)
def late_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls are folded by tool along each run; denials, which name a tool but have no call, are counted apart and joined to the result by that name."""
    tool = F.concat(F.lit("tool"), (F.get_json_object("props", "$.k").cast("bigint") % 40).cast("string"))
    e = table(spark, sf_dir, "events").withColumn("tool", tool)
    c = e.withColumn("nxt", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    fold = c.where("event_type = 'view'").groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.coalesce(F.col("nxt") == "click", F.lit(False))).alias("answered"))
    denied = e.where("event_type = 'error' and value > 60").groupBy("tool").agg(F.count("*").alias("denied"))
    return fold.join(denied, "tool", "left").withColumn("denied", F.coalesce("denied", F.lit(0)))


@query("u03_symbol_merge", "SELECT p_partkey AS id, p_brand AS name, 'primary' AS origin FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_brand, 'fallback' FROM part f WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size < 20 AND p.p_partkey = f.p_partkey AND p.p_brand = f.p_brand)")
def symbol_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one source has, and what only the other has, which looks at everything."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), "p_size")
    first = p.where("p_size < 20").select("id", "name", F.lit("primary").alias("origin"))
    return first.unionByName(p.select("id", "name", F.lit("fallback").alias("origin")).join(first.select("id", "name"), ["id", "name"], "left_anti").select("id", "name", "origin"))


@query("u05_transcript_digest", "SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def transcript_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each transcript, so that equal ones can be told."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("m")))), lambda x: x["m"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"))


@query("f07_ids", "SELECT doc_id, left(sha256(source), 16) AS workspace, sha256(doc_id || '-1-' || length(text) || '-' || left(text, 100)) AS segment FROM documents")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """short and long digests that name things."""
    segment = F.sha2(F.concat(F.col("doc_id"), F.lit("-1-"), F.length("text"), F.lit("-"), F.left("text", F.lit(100))), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2("source", 256), F.lit(16)).alias("workspace"), segment.alias("segment"))


@query("f08_remote", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://([^@/]*@)?', ''), '[?#].*$', ''), '/+$', ''), '\.git$', '') AS remote FROM pages")
def remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: addresses in one form."""
    return table(spark, sf_dir, "pages").select("page_id", H.remote(F.col("url")).alias("remote"))


@query("f10_scrub", f"SELECT doc_id, sha256({H.scrub_sql('text')}) AS clean FROM documents")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """personal data and secrets as marks; ten patterns in their order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(H.scrub(F.col("text")), 256).alias("clean"))


@query("f11_mask", f"WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{H.SECRET}', 1)) AS secret FROM documents) SELECT doc_id, {H.mask_sql('secret')} AS masked, count(*) AS n FROM s GROUP BY ALL")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets of known forms with their ends shown."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(H.secrets(F.col("text"))).alias("secret"))
    return s.groupBy("doc_id", H.mask(F.col("secret")).alias("masked")).agg(F.count("*").alias("n"))


@query("f11_credentials")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the stronger scrub, for texts that leave the house; the pattern looks ahead, which DuckDB's can't, so tests hold it against Python."""
    return table(spark, sf_dir, "documents").select("doc_id", H.scrub_credentials(F.col("text")).alias("text"))


@query("f12_fingerprint", f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'dev:' ELSE '' END || sha256({H.normalised_sql('array_to_string(string_split(text, chr(10))[1:6], chr(10))')}) AS fingerprint FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what reports of one fault have in common; those of development are kept apart."""
    f = H.fingerprint(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 10 == 0, "dev:").otherwise(""), f).alias("fingerprint"))


@query("f13_title", "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, left(CASE WHEN regexp_matches(coalesce(l[1], ''), '^\\[[^\\]]*\\]$') AND len(l) > 1 THEN l[1] || ' ' || l[2] ELSE coalesce(l[1], '') END, 200) AS title FROM l")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first full line of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", H.title(F.col("text")).alias("title"))


@query("f14_buckets", "WITH b AS (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS v, user_id FROM events) SELECT event_id, CASE WHEN v + user_id <= 0 THEN 'unknown' WHEN v * 100 // (v + user_id) < 1 THEN '0' WHEN v * 100 // (v + user_id) < 25 THEN '1_24' WHEN v * 100 // (v + user_id) < 50 THEN '25_49' WHEN v * 100 // (v + user_id) < 75 THEN '50_74' WHEN v * 100 // (v + user_id) < 90 THEN '75_89' ELSE '90_100' END AS cache, CASE WHEN v * 100 < 1000 THEN 'lt_1s' WHEN v * 100 < 5000 THEN 's_1_5' WHEN v * 100 < 15000 THEN 's_5_15' WHEN v * 100 < 60000 THEN 's_15_60' WHEN v * 100 < 300000 THEN 'm_1_5' WHEN v * 100 < 900000 THEN 'm_5_15' ELSE 'm_15_plus' END AS latency FROM b")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bands of cache shares and latencies."""
    v = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", H.cache_bucket(v, F.col("user_id")).alias("cache"), H.latency_bucket(v * 100).alias("latency"))


@query("f14_safe_bucket", "SELECT p_type, regexp_replace(lower(p_type), '[^a-z0-9_]+', '_', 'g') AS bucket, count(*) AS n FROM part GROUP BY ALL")
def safe_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names that are safe as keys."""
    return table(spark, sf_dir, "part").groupBy("p_type", H.safe_bucket(F.col("p_type")).alias("bucket")).agg(F.count("*").alias("n"))


@query("f17_clip", "SELECT doc_id, CASE WHEN length_grapheme(text) > 40 THEN left_grapheme(text, 39) || '…' ELSE text END AS clipped FROM documents")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that fit a width, cut between graphemes."""
    return table(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text"), 40).alias("clipped"))


@query("f18_slug", "SELECT p_partkey, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'topic') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names for addresses."""
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("f19_contains_link", "SELECT conv_id, turn, regexp_matches(lower(text), 'https?://|www\\.|[a-z0-9-]+\\.(com|net|org)') AS has_link FROM conversations")
def contains_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with a link."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"https?://|www\.|[a-z0-9-]+\.(com|net|org)").alias("has_link"))


@query(
    "f20_freshness",
    "WITH m AS (SELECT max(o_orderdate) - INTERVAL 5 DAY AS now FROM orders), w AS (SELECT o_orderkey, date_diff('second', o_orderdate, now) AS age, CASE WHEN o_orderpriority = '1-URGENT' THEN 14 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 90 ELSE 30 END AS fresh, CASE WHEN o_orderpriority = '1-URGENT' THEN 45 WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 365 ELSE 180 END AS current FROM orders, m) SELECT o_orderkey, CASE WHEN age < 0 THEN 'current' WHEN age <= fresh * 86400 THEN 'fresh' WHEN age <= current * 86400 THEN 'current' ELSE 'stale' END AS freshness FROM w",
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """age classes by windows of the type: 14 and 45 days for references, 90 and 365 for what users said, else 30 and 180; what lies ahead is current."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("at"))
    now = o.agg((F.max("at") - F.expr("interval 5 days")).alias("now"))
    age = F.unix_seconds("now") - F.unix_seconds("at")
    p = F.col("o_orderpriority")
    days = lambda a, b, c: F.when(p == "1-URGENT", a).when(p.isin("2-HIGH", "3-MEDIUM"), b).otherwise(c) * 86400
    c = F.when(age < 0, "current").when(age <= days(14, 90, 30), "fresh").when(age <= days(45, 365, 180), "current").otherwise("stale")
    return o.join(F.broadcast(now)).select("o_orderkey", c.alias("freshness"))


_SHAPE_SQL = """b AS (SELECT user_id, event_id // 50 AS batch, left(sha256(string_agg(DISTINCT CASE WHEN event_type IN ('signup', 'error') THEN event_type ELSE '' END, '' ORDER BY CASE WHEN event_type IN ('signup', 'error') THEN event_type ELSE '' END)), 16) AS system_hash,
  left(sha256(string_agg(DISTINCT CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type ELSE '' END, ',' ORDER BY CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type ELSE '' END)), 16) AS tools_hash FROM events GROUP BY ALL)"""


@query(
    "f23_prefix_shapes",
    f"WITH {_SHAPE_SQL}, l AS (SELECT *, left(sha256(system_hash || tools_hash), 16) AS prefix_hash, lag(system_hash) OVER w AS ps, lag(tools_hash) OVER w AS pt FROM b WINDOW w AS (PARTITION BY user_id ORDER BY batch)) SELECT user_id, batch, prefix_hash, array_to_string(list_filter([CASE WHEN ps <> system_hash THEN 'system' END, CASE WHEN pt <> tools_hash THEN 'tools' END], lambda x: x IS NOT NULL), ',') AS changed FROM l",
)
def prefix_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests of the parts of each request's prefix, with tools in order, and which parts changed since the request before."""
    system = F.col("event_type").isin("signup", "error")
    part = lambda own, sep: F.left(F.sha2(F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("event_type")).otherwise(""))), sep), 256), F.lit(16))
    b = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 50).alias("batch")).agg(part(system, "").alias("system_hash"), part(~system, ",").alias("tools_hash"))
    w = Window.partitionBy("user_id").orderBy("batch")
    differs = lambda c, name: F.when(F.lag(c).over(w) != F.col(c), name)
    changed = F.array_join(F.array_compact(F.array(differs("system_hash", "system"), differs("tools_hash", "tools"))), ",")
    return b.select("user_id", "batch", F.left(F.sha2(F.concat("system_hash", "tools_hash"), 256), F.lit(16)).alias("prefix_hash"), changed.alias("changed"))


@query("f24_unified_tally")
def unified_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines added and removed between neighbouring texts of a source in their order, exactly up to 2,000 changed lines; zero bytes mean binary.

    A longest common subsequence is beyond SQL; tests hold it against a plain one.
    """
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("pid"), (F.col("doc_id") % 2).alias("side"), "text")
    pair = d.groupBy("pid").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("old"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("new"))
    return pair.select("pid", tallies(F.col("old"), F.col("new")).alias("t")).select("pid", "t.binary", "t.added", "t.removed")


@query("f24_line_diff", f"WITH {_LINES_SQL}, pair AS (SELECT doc_id, doc_id % 2 AS side, doc_id // 2 AS pid, s FROM line), c AS (SELECT pid, s, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM pair GROUP BY pid, s) SELECT pid, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed FROM c GROUP BY pid")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines added and removed between two texts, as multisets."""
    c = lines(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 2).alias("pid"), "s").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    return c.groupBy("pid").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))


_LABEL_SQL = "CASE WHEN {0} >= 1000000 THEN CAST(round({0} / 1000000.0, 1) AS DOUBLE) || 'm' WHEN {0} >= 1000 THEN CAST(round({0} / 1000.0, 1) AS DOUBLE) || 'k' ELSE CAST(CAST(round({0}) AS BIGINT) AS VARCHAR) END"


@query(
    "f25_ticks",
    "WITH m AS (SELECT o_orderpriority, max(o_totalprice) AS top, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, unnest([top, n / 3.0, 3.0]) AS top FROM m), p AS (SELECT *, top / 4 AS raw, pow(10, floor(log10(greatest(top, 1) / 4))) AS mag FROM s), t AS (SELECT o_orderpriority, top, CASE WHEN top <= 4 THEN 1 WHEN raw / mag <= 1 THEN mag WHEN raw / mag <= 2 THEN 2 * mag WHEN raw / mag <= 5 THEN 5 * mag ELSE 10 * mag END AS step FROM p), k AS (SELECT o_orderpriority, top, step, unnest(range(1, CAST(floor(top / step) AS BIGINT) + 1)) * step AS tick FROM t) SELECT o_orderpriority, round(tick, 6) AS tick, replace("
    + _LABEL_SQL.format("tick")
    + ", '.0', '') AS label FROM k",
)
def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the marks of an axis at round steps, with short labels."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_totalprice").alias("top"), F.count("*").alias("n"))
    s = m.select("o_orderpriority", F.explode(F.array("top", F.col("n") / 3.0, F.lit(3.0))).alias("top"))
    step = X.tick_step(F.col("top"), 4)
    k = s.withColumn("step", step).select("o_orderpriority", F.explode(F.transform(F.sequence(F.lit(1), F.floor(F.col("top") / F.col("step"))), lambda i: i * F.col("step"))).alias("tick"))
    return k.select("o_orderpriority", F.round("tick", 6).alias("tick"), X.tick_label(F.col("tick")).alias("label"))


_CJK_SQL = r"length(regexp_replace(text, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'))"
_LATIN_SQL = r"length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))"


@query("f26_language", f"SELECT doc_id, CASE WHEN {_CJK_SQL} > 100 AND {_CJK_SQL} * 4 > {_LATIN_SQL} THEN 'zh-CN' ELSE 'en' END AS of_text, CASE WHEN {_CJK_SQL} > 0 THEN 'zh-CN' ELSE 'en' END AS of_query FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || repeat('検索', CAST(50 + doc_id % 800 AS INT)) ELSE text END AS text FROM documents)")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese or English: of a document by how many characters are CJK, of a query by whether any is. Every ninth text has some words put behind it."""
    own = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.repeat(F.lit("検索"), (50 + F.col("doc_id") % 800).cast("int")))).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", own.alias("text"))
    return d.select("doc_id", X.document_language(F.col("text")).alias("of_text"), X.query_language(F.col("text")).alias("of_query"))


@query("f27_error_text", "SELECT conv_id, turn FROM conversations WHERE starts_with(lower(text), 'error') OR contains(lower(text), 'th error') OR contains(lower(text), 'failed')")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """results that tell of an error."""
    low = F.lower("text")
    return table(spark, sf_dir, "conversations").where(low.startswith("error") | low.contains("th error") | low.contains("failed")).select("conv_id", "turn")


@query("f28_frontmatter", "WITH m AS (SELECT p_partkey, '---' || chr(10) || 'name: ' || p_brand || chr(10) || 'size: ' || p_size || chr(10) || '---' || chr(10) || p_name AS t FROM part) SELECT p_partkey, regexp_extract(t, 'name: ([^\\n]*)', 1) AS name, CAST(regexp_extract(t, 'size: (\\d+)', 1) AS BIGINT) AS size, regexp_extract(t, '(?s)^---\\n.*?\\n---\\n(.*)$', 1) AS body FROM m")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the head of a note as a map, and its body."""
    t = F.concat(F.lit("---\nname: "), "p_brand", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit("\n---\n"), "p_name")
    head = F.regexp_extract(t, r"(?s)^---\n(.*?)\n---\n", 1)
    m = F.str_to_map(head, F.lit("\n"), F.lit(": "))
    return table(spark, sf_dir, "part").select("p_partkey", m["name"].alias("name"), m["size"].cast("bigint").alias("size"), F.regexp_extract(t, r"(?s)^---\n.*?\n---\n(.*)$", 1).alias("body"))


@query("f29_tree_fingerprint", "WITH c AS (SELECT source, doc_id // 1000 AS part, count(*) AS n, sha256(string_agg(doc_id || ':' || n_chars, ',' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, ',' ORDER BY part)) AS tree FROM c GROUP BY source")
def tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a digest over the sorted entries of a folder, by way of digests of a thousand neighbouring numbers, so that no task holds all entries of a folder."""
    e = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "n_chars"))), lambda x: F.concat_ws(":", x["doc_id"], x["n_chars"]))
    c = table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(e, ","), 256).alias("h"))
    h = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])
    return c.groupBy("source").agg(F.sum("n").alias("files"), F.sha2(F.array_join(h, ","), 256).alias("tree"))


# Parts as lines of code in several languages.
CODE = [
    (".py", "class {0}:"), (".py", "    async def {0}(self):"), (".ts", "export default class {0} extends B {{"), (".js", "export async function {0}(a) {{"), (".ts", "export interface {0} {{"), (".ts", "type {0} = A | B"), (".tsx", "enum {0} {{"),
    (".js", "const {0} = async (x) => {{"), (".java", "public final class {0} {{"), (".cs", "  public static int {0}(int a) {{"), (".kt", "data class {0}(val a: Int)"), (".rs", "pub(crate) fn {0}<T>(a: T)"), (".rs", "struct {0};"),
    (".c", "static int {0}(void) {{"), (".py", "x = {0}(1)"), (".md", "class {0}"), (".h", "int {0}(void);"), (".js", "return {0}"),
]
_WORD_SQL = "replace(p_name, ' ', '_')"
_CODE_SQL = f"code AS (SELECT p_partkey, {[e for e, _ in CODE]!r}[p_partkey % {len(CODE)} + 1] AS ext, replace({[t.replace('{{', '{') for _, t in CODE]!r}[p_partkey % {len(CODE)} + 1], '{{0}}', {_WORD_SQL}) AS line FROM part)"
_SYMBOL_NAME_SQL, _SYMBOL_KIND_SQL = declaration_sql("line", "ext")


@query("r07_symbols", f"WITH {_CODE_SQL}, s AS (SELECT p_partkey, ext, {_SYMBOL_NAME_SQL} AS name, {_SYMBOL_KIND_SQL} AS kind FROM code) SELECT p_partkey, ext, name, kind FROM s WHERE name IS NOT NULL")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations in lines of code, by the first pattern of the line's language that fits."""
    at = (F.col("p_partkey") % len(CODE) + 1).cast("int")
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), at)
    line = F.replace(of([t.replace("{{", "{") for _, t in CODE]), F.lit("{0}"), F.replace("p_name", F.lit(" "), F.lit("_")))
    code = table(spark, sf_dir, "part").select("p_partkey", of([e for e, _ in CODE]).alias("ext"), line.alias("line"))
    return code.withColumn("d", declaration(F.col("line"), F.col("ext"))).where("d is not null").select("p_partkey", "ext", "d.name", "d.kind")


@query("r09_nested_json", "SELECT event_id AS seq, event_type AS kind, CASE WHEN event_type = 'view' THEN 'tool' || user_id END AS tool, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS prompt_tokens FROM events WHERE event_id % 8 <> 0")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few fields of nested records, read with a schema that holds only these; every eighth line is torn and dropped."""
    tool = F.when(F.col("event_type") == "view", F.struct(F.concat(F.lit("tool"), F.col("user_id")).alias("name"), F.col("props").alias("args"), F.lit(True).alias("readOnly")))
    used = F.when(F.col("event_type") == "click", F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("promptTokens"), F.lit(0).alias("completionTokens")))
    raw = F.to_json(F.struct(F.col("event_id").alias("seq"), F.struct(F.col("event_type").alias("kind"), tool.alias("tool"), used.alias("usage"), F.col("value").alias("unread")).alias("event")))
    line = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 8 == 0, F.left(raw, F.lit(7))).otherwise(raw).alias("line"))
    r = line.select(F.from_json("line", "seq bigint, event struct<kind:string, tool:struct<name:string>, usage:struct<promptTokens:bigint>>").alias("r")).where("r.seq is not null")
    return r.select("r.seq", "r.event.kind", F.col("r.event.tool.name").alias("tool"), F.col("r.event.usage.promptTokens").alias("prompt_tokens"))


_REPORT_SQL = "r AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN ' Dev ' ELSE 'stable' END AS channel, CASE WHEN user_id % 7 = 0 THEN 'dev-1' ELSE 'v1.2.0' END AS version, CASE WHEN event_type = 'error' THEN 'crash' ELSE 'note' END AS kind, ['Script error. ', 'ResizeObserver loop limit exceeded', 'Minified React error #520; visit', 'Minified React error #5201', 'x'][event_id % 5 + 1] AS message, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'main.js:1' END AS top_frame FROM events)"


@query(
    "p11_report_flags",
    f"WITH {_REPORT_SQL} SELECT event_id, lower(trim(channel)) = 'dev' OR starts_with(lower(trim(version)), 'dev') AS development, regexp_matches(trim(message), '^ResizeObserver loop (limit exceeded|completed with undelivered notifications\\.?)$') OR regexp_matches(message, 'Minified React error #520\\b') AS no_crash, kind = 'crash' AND trim(message) = 'Script error.' AND trim(top_frame) = '' AS opaque FROM r",
)
def report_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of development builds, notices that are no crash, and reports that tell nothing."""
    message = F.element_at(F.array(*map(F.lit, ("Script error. ", "ResizeObserver loop limit exceeded", "Minified React error #520; visit", "Minified React error #5201", "x"))), (F.col("event_id") % 5 + 1).cast("int"))
    r = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 5 == 0, " Dev ").otherwise("stable").alias("channel"), F.when(F.col("user_id") % 7 == 0, "dev-1").otherwise("v1.2.0").alias("version"),
        F.when(F.col("event_type") == "error", "crash").otherwise("note").alias("kind"), message.alias("message"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("main.js:1").alias("top_frame"),
    )
    return r.select("event_id", H.is_development(F.col("channel"), F.col("version")).alias("development"), H.is_no_crash(F.col("message")).alias("no_crash"), H.is_opaque(F.col("kind"), F.col("message"), F.col("top_frame")).alias("opaque"))


@query("r10_snip", "SELECT conv_id, turn, CASE WHEN strlen(text) >= 1024 AND length(text) > 280 THEN left(text, 200) || chr(10) || '[... omitted ...]' || chr(10) || right(text, 80) ELSE text END AS t FROM conversations")
def snips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long results with their middle left out."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", H.snip(F.col("text"), 200, 80).alias("t"))


@query("s23_rooted_search", f"WITH {_LINES_SQL} SELECT source, count(*) AS hits FROM line JOIN documents USING (doc_id) WHERE contains(s, ' tionnt') GROUP BY source")
def rooted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by the root that they are under."""
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit(" tionnt")))
    return d.select("source", F.explode(F.split("text", "\n", -1)).alias("s")).where(F.contains("s", F.lit(" tionnt"))).groupBy("source").agg(F.count("*").alias("hits"))


@query("s12_listing", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below each folder."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


# Graphs: every part depends on the part with half its number.


@query("g03_rank", "WITH RECURSIVE r AS (SELECT p_partkey AS node, p_partkey // 2 AS up, 0 AS depth FROM part UNION ALL SELECT node, up // 2, depth + 1 FROM r WHERE up > 0) SELECT node, max(depth) AS depth FROM r GROUP BY node")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each node stands below the roots; by doubling, so that the rounds grow with the logarithm of the depth."""
    from quern.operators.graphs import depths

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 2).alias("up"))
    return depths(p.select("node", F.when(F.col("up") > 0, F.col("up")).alias("up")))


@query("g04_lineage", "WITH RECURSIVE r AS (SELECT p_partkey AS node, p_partkey AS cur FROM part UNION ALL SELECT node, cur // 2 FROM r WHERE cur > 1) SELECT node, min(cur) AS root FROM r GROUP BY node")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session that each branch comes from."""
    from quern.operators.graphs import roots

    return roots(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("up")))


@query("g02_cycles", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r AS (SELECT a AS node, b AS cur, 1 AS n FROM e UNION ALL SELECT r.node, e.b, n + 1 FROM r JOIN e ON r.cur = e.a WHERE n < 25) SELECT DISTINCT node FROM r WHERE node = cur")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle of single links."""
    from quern.operators.graphs import on_cycles

    e = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("bigint").alias("b"))
    return on_cycles(e)


_BLOCKS = "e AS (SELECT c_custkey AS a, c_custkey // 20 * 20 + (c_custkey * 3 + 1) % 20 AS b FROM customer WHERE c_custkey % 5 < 3 UNION SELECT c_custkey, c_custkey // 20 * 20 + (c_custkey + 7) % 20 FROM customer WHERE c_custkey % 3 = 0)"


@query("g02_strong_components", f"WITH RECURSIVE {_BLOCKS}, r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), n AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, least(node, min(back.a)) AS component FROM n LEFT JOIN r ON r.a = node LEFT JOIN r back ON back.a = r.b AND back.b = node GROUP BY node")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lead to each other, in a graph with several links each way."""
    from quern.operators.graphs import strong_components

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("a"))
    to = lambda x: F.floor(F.col("a") / 20) * 20 + x % 20
    return strong_components(c.where("a % 5 < 3").withColumn("b", to(F.col("a") * 3 + 1)).union(c.where("a % 3 = 0").withColumn("b", to(F.col("a") + 7))))


@query("g01_order", "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey // d AS a, p_partkey AS b FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey // d > 0), r AS (SELECT p_partkey AS node, 0 AS layer FROM part UNION SELECT e.b, layer + 1 FROM r JOIN e ON e.a = r.node), l AS (SELECT node, max(layer) AS layer FROM r GROUP BY node) SELECT node, layer, row_number() OVER (ORDER BY layer, node) AS place, row_number() OVER (ORDER BY layer DESC, node DESC) AS drain FROM l")
def activation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: an order in which every part comes after those with half and with a third of its number, ties by number, and the reverse order."""
    from quern.operators.graphs import order

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("node"))
    e = p.select(F.explode(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3))).alias("a"), F.col("node").alias("b"))
    return order(e.where("a > 0"), p)


@query("g01_layers", "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey // d AS a, p_partkey AS b FROM part, (SELECT unnest([2, 3]) AS d) WHERE p_partkey // d > 0), n AS (SELECT a AS node FROM e UNION SELECT b FROM e), r AS (SELECT node, 0 AS layer FROM n UNION SELECT e.b, layer + 1 FROM r JOIN e ON e.a = r.node) SELECT node, max(layer) AS layer FROM r GROUP BY node")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: an order of a graph in which nodes have several links each way, layer by layer: every part comes after those with half and with a third of its number."""
    from quern.operators.graphs import layers

    e = table(spark, sf_dir, "part").select(F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3))).alias("a"), F.col("p_partkey").alias("b"))
    return layers(e.where("a > 0"))
