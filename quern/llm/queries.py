"""Registered queries of the training-data operators, and the SQL that states their results."""

from __future__ import annotations

import secrets
import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import audit, decontaminate, fertility, jaccard, languages, negatives, packing, pieces, privacy, quality, repeats, toxicity, webtext
from quern.llm import textpack as tp

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def small_batches(spark: SparkSession) -> None:
    """Bounds what an executor holds of texts on their way to Python: fewer rows in a batch than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(tp.BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract(table(spark, sf_dir, "pages"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES, texts=False)


KEY = "spark.quern.surrogateKey"


def secret_key(spark: SparkSession) -> str:
    """The key of surrogates, which is the user's to set; a session without one makes a random key and keeps it, so its surrogates can't be made again elsewhere."""
    if not spark.conf.get(KEY, None):
        warnings.warn(f"{KEY} is not set: surrogates follow from a random key of this session", stacklevel=2)
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pseudonymise(table(spark, sf_dir, "documents"), secret_key(spark)).select("doc_id", "text", "pii_types")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that op4_jaccard with numbers of links had; it has them itself now."""
    return op4_jaccard(spark, sf_dir)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), texts=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge(table(spark, sf_dir, "documents"), PIECES, RANKS, public_tokenizers.PATTERN)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fertility_group", "chars_per_token", "byte_share", "entropy", "word_chars_per_token", "reasons")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES)


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.shifted(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_webtext": op1_webtext,
    "op2_pieces": op2_pieces,
    "op3_surrogates": op3_surrogates,
    "op4_jaccard": op4_jaccard,
    "op4_links": op4_links,
    "op5_repeats": op5_repeats,
    "op6_quality": op6_quality,
    "op7_fertility": op7_fertility,
    "op8_toxicity": op8_toxicity,
    "op9_languages": op9_languages,
    "op10_decontaminate": op10_decontaminate,
    "op11_packing": op11_packing,
    "op12_interactions": op12_interactions,
    "op13_negatives": op13_negatives,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_jaccard": rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM doc WHERE len(w) BETWEEN 1 AND 4
  )
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
  LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM edge GROUP BY x) l USING (doc_id)
""",
    "op5_repeats": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM doc),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least_doc USING (s) WHERE m < doc_id),
kept AS (
  SELECT doc_id, count(gone.i) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN x END, ' ' ORDER BY i) AS t
  FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
""",
    "op10_decontaminate": rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
),
doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))
),
hit AS (SELECT dwin.doc_id, dwin.i, dwin.n, win.item_id FROM dwin JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
""",
}

ORACLE_SQL["op12_interactions"] = r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_doc AS (SELECT t, min(doc_id) AS m FROM doc GROUP BY t),
flag AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > m)::INT AS fails
  FROM doc JOIN least_doc USING (t) LEFT JOIN labels USING (doc_id)
),
letter AS (SELECT unnest(range(0, 5)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s AS step, o[s] AS f, CAST(list_sum([0] || list_transform(o[1 : s - 1], lambda x: 1 << x)) AS BIGINT) AS before FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders)),
mask AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM flag GROUP BY ALL),
counted AS (
  SELECT part, o, step, f, sum(n) FILTER (fails & (before | (1 << f)) = 0) AS kept, sum(n) FILTER (fails & before = 0 AND (fails >> f) & 1 = 1) AS removed,
         sum(n) FILTER (fails & before <> 0 AND (fails >> f) & 1 = 1) AS redundant, sum(n) FILTER (fails = 1 << f) AS unique_fails,
         sum(g) FILTER (fails & before = 0 AND (fails >> f) & 1 = 1) AS good_lost, sum(x) FILTER (fails & before = 0 AND (fails >> f) & 1 = 1) AS toxic_lost
  FROM mask, steps GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x + 1 AS BIGINT), 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL["op13_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (SELECT a.vec_id AS a, a.label AS own, b.vec_id AS b, b.label AS other, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, own, b, score FROM s WHERE own = other QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND s.other <> p.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLE_SQL["op4_links"] = ORACLE_SQL["op4_jaccard"]
