"""Full-text, vector and section search."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import markdown as md
from quern.functions import text as X
from quern.operators import ann, pq, ranking, vectors
from quern.operators.lineage import cut, shared_folder
from quern.plans.registry import query
from quern.sources.tables import table

QUERY = "the thing with that nation of order"
TERMS = ["the", "thing", "with", "that", "nation", "of", "order"]
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
TOKENS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{Nd}}_]+')"


def bm25_sql(source: str, key: str, text: str) -> str:
    """CTEs ``scored`` (key, score, matched) for BM25 over ``source``."""
    return f"""
tok AS (SELECT {key}, {TOKENS_SQL.format(text)} AS w FROM {source}),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM tok),
hit AS (SELECT {key}, len AS n, term, count(*) AS tf FROM (SELECT {key}, len(w) AS len, unnest(w) AS term FROM tok) WHERE list_contains({_TERMS_SQL}, term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (
  SELECT {key}, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS score, count(*) AS matched
  FROM hit JOIN df USING (term), stats GROUP BY {key})"""


@query("v03_bm25_search", f"WITH {bm25_sql('documents', 'doc_id', 'text')}, top AS (SELECT * FROM scored WHERE score >= 0.15 * (SELECT max(score) FROM scored) ORDER BY round(score, 6) DESC, doc_id LIMIT 20) SELECT doc_id, round(score, 6) AS score, matched FROM top")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a query, above the relative floor."""
    docs = table(spark, sf_dir, "documents")
    scored = ranking.floor(ranking.bm25(docs, ranking.query_terms(QUERY, spark), "doc_id", F.col("text")), 0.15)
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", "score", "matched")


@query("v03_postings_search", f"WITH {bm25_sql('documents', 'doc_id', 'text')}, top AS (SELECT * FROM scored WHERE score >= 0.15 * (SELECT max(score) FROM scored) ORDER BY round(score, 6) DESC, doc_id LIMIT 20) SELECT doc_id, round(score, 6) AS score, matched FROM top")
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, F2: the same from an index that is written once; a search opens the folders of its terms only."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    ranking.build_postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), path)
    scored = ranking.floor(ranking.search_postings(spark, path, ranking.query_terms(QUERY, spark)), 0.15)
    return scored.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "matched").orderBy(F.desc("score"), "doc_id").limit(20)


@query("v03_conversation_search", f"WITH turns AS (SELECT conv_id, turn, text FROM conversations WHERE role IN ('user', 'assistant')), {bm25_sql('turns', 'conv_id, turn', 'text')} SELECT conv_id, turn, round(score, 6) AS score FROM scored WHERE score >= 0.15 * (SELECT max(score) FROM scored) ORDER BY round(score, 6) DESC, conv_id, turn LIMIT 8")
def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, P5: the best messages of two roles."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).select(F.struct("conv_id", "turn").alias("id"), "text")
    scored = ranking.floor(ranking.bm25(turns, TERMS, "id", F.col("text")), 0.15).withColumn("score", F.round("score", 6))
    return scored.orderBy(F.desc("score"), "id").limit(8).select("id.conv_id", "id.turn", "score")


@query("a35_term_statistics", f"WITH tok AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 3")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of every term, counted in each task before the one shuffle by term."""
    return X.term_counts(table(spark, sf_dir, "documents").select(F.lower("text").alias("low")), "low").where("df >= 3")


@query("f01_tokens", f"SELECT conv_id, turn, len({TOKENS_SQL.format('text')}) AS n_tokens, len(list_distinct({TOKENS_SQL.format('text')})) AS n_terms FROM conversations")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct tokens of each message."""
    toks = X.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(toks).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("bigint").alias("n_terms"))


_COMPACT = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(
    "f03_snippet",
    f"""WITH flat AS (SELECT doc_id, {_COMPACT.format("text")} AS t FROM documents),
pos AS (SELECT *, CASE WHEN instr(lower(t), 'of the') > 0 THEN instr(lower(t), 'of the') WHEN instr(lower(t), 'nation') > 0 THEN instr(lower(t), 'nation') WHEN instr(lower(t), 'thing') > 0 THEN instr(lower(t), 'thing') ELSE 1 END - 1 AS p FROM flat),
b AS (SELECT *, greatest(0, least(greatest(p - 60, 0), length(t) - 120)) AS s FROM pos)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substring(t, s + 1, 120) || CASE WHEN s + 120 < length(t) THEN '...' ELSE '' END END AS snippet FROM b""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a window of each text around a phrase or the first term."""
    terms = F.array(F.lit("nation"), F.lit("thing"))
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("of the"), terms, 120).alias("snippet"))


_VEC_SQL = """
q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])), 6) AS score FROM embeddings, q)"""


@query("t01_vector_topk", f"WITH {_VEC_SQL} SELECT vec_id, label, score FROM s ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors of one query vector."""
    return vectors.topk(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)


@query("j11_vector_join", "WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s) SELECT query, id, score, place FROM n WHERE place <= 10")
def vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every fiftieth one, exact; blocks of queries meet blocks of rows."""
    e = table(spark, sf_dir, "embeddings")
    return ann.exact(e, e.where("vec_id % 50 = 0"), 10)


@query("v06_inverted_file")
def inverted_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: nearly the same by an index of product-quantised residuals in lists; only rows that the codes put first are read as vectors. Tests measure recall against the exact search."""
    e, path = table(spark, sf_dir, "embeddings"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    model = pq.fit(e)
    if model is None:
        return ann.exact(e, e, 10)
    pq.build(e, path, model)
    return pq.search(path, e, e.where("vec_id % 50 = 0"), 10)


_Q8_SQL = "list_transform({0}, lambda x: CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127))) AS BIGINT))"


@query("v01_rerank", f"WITH {_VEC_SQL}, c AS (SELECT s.*, e.embedding, q.qe FROM s JOIN embeddings e USING (vec_id), q ORDER BY score DESC, vec_id LIMIT 60), f AS (SELECT vec_id, label, score, CAST(list_sum(list_transform(list_zip({_Q8_SQL.format('embedding')}, {_Q8_SQL.format('qe')}), lambda p: p[1] * p[2])) AS BIGINT) AS second FROM c WHERE label < 5) SELECT vec_id, label, score, second FROM f ORDER BY second DESC, score DESC, vec_id LIMIT 10")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, T4: six candidates for each result, those of some places only, then a second order of what is left, and its first ten.

    The second score is here that of the vectors in bytes; ``x01_embedded_search`` does the same with models.
    """
    e, asked = table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir)
    found = vectors.topk(e, asked, vectors.candidates(10)).where("label < 5")
    q = F.array(*(F.lit(max(-128, min(127, math.floor(x * 127)))) for x in asked))
    # Sixty rows at most are joined back to their vectors.
    second = e.join(F.broadcast(found.select("vec_id", "score")), "vec_id").withColumn("second", vectors.dot_int(vectors.quantise(F.col("embedding")), q))
    return second.select("vec_id", "label", "score", "second").orderBy(F.desc("second"), F.desc("score"), "vec_id").limit(10)


@query("p04_filter_after_topk", f"WITH {_VEC_SQL}, c AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 60) SELECT vec_id, label, score FROM c WHERE label % 2 = 0")
def filter_after_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter after the candidates are chosen; it may leave fewer than were asked for."""
    return vectors.topk(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 60).where("label % 2 = 0")


@query("f06_quantise", "SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127))) AS INTEGER))[1] AS q0, CAST(list_sum(list_transform(embedding, lambda x: CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127))) AS BIGINT) * CAST(greatest(-128, least(127, floor(CAST(x AS DOUBLE) * 127))) AS BIGINT))) AS BIGINT) AS norm2 FROM embeddings")
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors in one byte a dimension, and their squared norm in whole numbers."""
    q = vectors.quantise(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    return e.select("vec_id", F.element_at("q", 1).cast("int").alias("q0"), vectors.dot_int(F.col("q"), F.col("q")).alias("norm2"))


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"])


@query("w02_context_window", "WITH hit AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE contains(lower(text), 'thing')) SELECT DISTINCT c.conv_id, c.turn, c.role FROM conversations c JOIN hit h ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 3 AND h.turn + 3")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns up to three before or after a hit, by a window over each conversation and no join."""
    c = table(spark, sf_dir, "conversations").withColumn("hit", F.lower("text").contains("thing").cast("int"))
    near = F.max("hit").over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-3, 3))
    return c.withColumn("near", near).where("near = 1").select("conv_id", "turn", "role").distinct()


# Documents as Markdown: some lines become headings of four levels (and a fifth, which is none), and some stand between fences.
_MARK_SQL = "CASE WHEN i % 23 IN (7, 11) THEN '```' WHEN i % 5 = 0 AND s <> '' THEN repeat('#', 1 + (i + doc_id) % 5) || ' ' || left(s, 30) || CASE WHEN i % 10 = 0 THEN ' ##' ELSE '' END ELSE s END"
_MD_SQL = rf"""line AS (SELECT doc_id, i, {_MARK_SQL} AS s FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
f AS (SELECT *, regexp_matches(s, '^ {{0,3}}(```|~~~)') AS fence FROM line), o AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS open FROM f),
h AS (SELECT *, CASE WHEN NOT open AND NOT fence AND trim(regexp_extract(s, '^ {{0,3}}(#{{1,4}})[ \t]+(.*?)([ \t]+#+)?[ \t]*$', 2)) <> '' THEN trim(regexp_extract(s, '^ {{0,3}}(#{{1,4}})[ \t]+(.*?)([ \t]+#+)?[ \t]*$', 2)) END AS heading FROM o),
g AS (SELECT *, CASE WHEN heading IS NOT NULL THEN length(regexp_extract(s, '^ {{0,3}}(#{{1,4}})', 1)) END AS level, count(heading) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h),
k AS (SELECT *, """ + ", ".join(f"max(CASE WHEN level = {n} THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS a{n}" for n in range(1, 5)) + r""" FROM g),
t AS (SELECT k.*, """ + ", ".join(f"(SELECT heading FROM g WHERE g.doc_id = k.doc_id AND g.i = a{n}) AS t{n}" for n in range(1, 5)) + r""", (SELECT arg_min(heading, i) FROM g WHERE g.doc_id = k.doc_id AND level = 1) AS title FROM k),
sec AS (SELECT doc_id, section, coalesce(max(level), 0) AS level, min(i) + 1 AS start_line, max(i) + 1 AS end_line, coalesce(any_value(title), '') AS title, trim(string_agg(s, chr(10) ORDER BY i)) AS content,
  arg_min(array_to_string(list_filter([t1, CASE WHEN a2 > coalesce(a1, -1) THEN t2 END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN t3 END, CASE WHEN a4 > greatest(coalesce(a1, -1), coalesce(a2, -1), coalesce(a3, -1)) THEN t4 END], lambda x: x IS NOT NULL), ' > '), i) AS trail FROM t GROUP BY doc_id, section),
sections AS (SELECT doc_id, section, level, CASE WHEN level = 0 THEN title ELSE trail END AS trail, title, start_line, end_line, content FROM sec WHERE regexp_matches(content, '\S'))"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda x, i: F.when((i % 23).isin(7, 11), "```").when((i % 5 == 0) & (x != ""), F.concat(F.substring(F.lit("#####"), F.lit(1), (1 + (i + F.col("doc_id")) % 5).cast("int")), F.lit(" "), F.left(x, F.lit(30)), F.when(i % 10 == 0, " ##").otherwise(""))).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


@query("r06_sections", f"WITH {_MD_SQL} SELECT doc_id, section, level, trail, title, start_line, end_line, sha256(content) AS digest FROM sections")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of Markdown by headings of four levels, each with the trail of headings above it."""
    s = md.sections(markdown(spark, sf_dir), "doc_id", "text")
    return s.select("doc_id", "section", "level", "trail", "title", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


_HEAD_TOKENS_SQL = TOKENS_SQL.format("title || ' ' || trail")
_PHRASE = "of the"


@query(
    "v05_section_search",
    f"""WITH {_MD_SQL}, texts AS (SELECT doc_id, section, title, trail, title || chr(10) || trail || chr(10) || content AS t FROM sections), {bm25_sql("texts", "doc_id, section", "t")},
b AS (SELECT doc_id, section, (coalesce(score, 0) + CASE WHEN doc_id % 40 = 7 THEN 100 ELSE 0 END + 0.35 * len(list_intersect({_TERMS_SQL}, {_HEAD_TOKENS_SQL})) + CASE WHEN contains(lower(t), '{_PHRASE}') THEN 1.5 ELSE 0 END) * CASE WHEN lang = 'de' THEN 1.15 ELSE 1 END AS score
  FROM texts LEFT JOIN scored USING (doc_id, section) JOIN documents USING (doc_id) WHERE score > 0 OR doc_id % 40 = 7)
SELECT doc_id, section, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, doc_id, section LIMIT 20""",
)
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by BM25 over title, trail and text, with bonuses: for query terms in the headings, for the phrase, for the language, and for the very release asked for."""
    docs = markdown(spark, sf_dir)
    s = cut(md.sections(docs, "doc_id", "text").withColumn("t", F.concat_ws("\n", "title", "trail", "content")).select(F.struct("doc_id", "section").alias("id"), "doc_id", "t", F.concat_ws(" ", "title", "trail").alias("head")))
    scored = ranking.bm25(s, TERMS, "id", F.col("t"))
    release = F.col("doc_id") % 40 == 7  # documents of the release that is asked for
    all_of = s.join(docs.select("doc_id", "lang"), "doc_id").join(scored, "id", "left").where((F.coalesce("score", F.lit(0.0)) > 0) | release)
    own = ranking.boosted(F.coalesce("score", F.lit(0.0)), TERMS, X.tokens(F.col("head")), F.contains(F.lower("t"), F.lit(_PHRASE)), F.col("lang") == "de", release)
    return all_of.select("id", F.round(own, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20).select("id.doc_id", "id.section", "score")


@query(
    "v04_recall",
    f"""WITH {bm25_sql("documents", "doc_id", "text")},
aged AS (SELECT doc_id, matched, score * CASE WHEN source IN ('src0', 'src1') THEN 1.08 ELSE 1 END * CASE WHEN doc_id % 5 = 0 THEN 0.92 ELSE 1 END AS score, n_chars FROM scored JOIN documents USING (doc_id)
  WHERE matched >= 2 OR (matched = 1 AND doc_id IN (SELECT doc_id FROM hit WHERE term IN ('nation')))),
top AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rn FROM aged WHERE score >= 0.24 * (SELECT max(score) FROM aged) QUALIFY rn <= 4)
SELECT doc_id, round(score, 6) AS score, least(n_chars, 2400) AS shown FROM top WHERE rn = 1 OR (SELECT coalesce(sum(least(n_chars, 2400)), 0) FROM top p WHERE p.rn < top.rn) < 2400""",
)
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong matches only, weights by scope and age, a floor, four results, and a budget of characters; a query that only says to go on recalls nothing."""
    docs = table(spark, sf_dir, "documents")
    asked = "the thing with that #nation of order"
    if ranking.is_generic(asked):
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"), F.col("n_chars").alias("shown"))
    scored = ranking.bm25(docs, TERMS, "doc_id", F.col("text"), terms_too=True).where(ranking.strong_match(asked, TERMS, F.col("terms"))).join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    weight = F.when(F.col("source").isin("src0", "src1"), 1.08).otherwise(1.0) * F.when(F.col("doc_id") % 5 == 0, 0.92).otherwise(1.0)
    best = ranking.floor(scored.withColumn("score", F.col("score") * weight), 0.24).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(4)
    order = Window.orderBy(F.desc("score"), "doc_id")  # over four rows
    shown = F.least("n_chars", F.lit(2400))
    spent = F.coalesce(F.sum(shown).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("spent", spent).where("spent = 0 or spent < 2400").select("doc_id", "score", shown.alias("shown"))