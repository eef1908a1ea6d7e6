"""What must not grow with the tables: batches on their way to Python, rows and bytes that are shuffled."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.operators import batches, pq, ranking
from quern.sources.tables import table

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def widest(rows) -> int:
    """The most bytes in a batch that Python gets of ``rows``, read as the session stands now."""

    def size(parts):
        for p in parts:
            yield pa.RecordBatch.from_arrays([pa.array([p.nbytes])], ["n"])

    return rows.coalesce(1).mapInArrow(size, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["r01_chunks", "r02_structural_chunks", "s15_decode"])
def test_batches_of_texts_are_bounded(name, spark, small):
    texts = spark.range(3000).select("id", F.repeat(F.lit("x"), 5000).alias("text"))
    spark.conf.unset(BOUND)
    assert widest(texts) > 2 * batches.BYTES
    __spark_entry__.queries()[name](spark, small)
    assert widest(texts) <= batches.BYTES + 10_000


def test_an_index_has_few_blocks(spark, tmp_path):
    """A block of queries leaves its first rows for each block of codes, so those must not be as many as there are lists."""
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    model = pq.fit(e)
    pq.build(e, str(tmp_path / "index"), model)
    codes = spark.read.parquet(str(tmp_path / "index" / "codes"))
    assert codes.count() <= 8 < len(model.centres)  # a few for each task that wrote them
    assert codes.agg(F.sum("rows")).first()[0] == e.count()


def test_first_rows_of_a_block_by_brute_force():
    rng = np.random.Generator(np.random.PCG64(3))
    model = pq.Model(rng.normal(size=(6, 10)), rng.normal(size=(3, 5, 4)), 3, 2)
    lists, codes = np.sort(rng.integers(2, 4, 60)).astype(np.int32), rng.integers(0, 2, (60, 3)).astype(np.uint8)  # few codes, so many ties
    ids, q = rng.permutation(60), rng.normal(size=(7, 10))
    reads = rng.random((7, 2)) < 0.6
    reads[0], reads[1] = True, False
    block = SimpleNamespace(group=1, ids=ids.tobytes(), lists=lists.tobytes(), codes=codes.tobytes(), q_ids=np.arange(7).tobytes(), q_vecs=q.tobytes(), reads=reads.tobytes())
    x = model.decode(lists, codes)
    for m in (1, 5, 59, 60, 100):
        got = pq._first(model, block, m)
        for n in range(7):
            want = sorted((-round(float(q[n] @ x[i]), 9), int(ids[i])) for i in range(60) if reads[n, lists[i] - 2])[:m]
            assert sorted(got.loc[got["query"] == n, "id"]) == sorted(i for _, i in want)


def test_units_of_odd_rows(spark):
    rows = [(1, [3.0, 4.0]), (2, [5.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf")]), (None, [1.0]), (9, [0.0, -2.0, 0.0])]
    got = pq._units(spark.createDataFrame(rows, "id long, v array<float>").coalesce(1), "id", "v").collect()
    assert {r.id: r.vec for r in got} == {1: pytest.approx([0.6, 0.8]), 2: [1.0], 9: [0.0, -1.0, 0.0]}


def test_an_index_of_postings_reads_texts_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def words(text):
        seen.add(1)
        return None if text is None else text.split()

    monkeypatch.setattr(ranking, "tokens", lambda text: F.udf(words, "array<string>")(text))
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c")], "id long, text string")
    ranking.build_postings(docs, "id", F.col("text"), str(tmp_path / "index"))
    assert seen.value == 4
    rows = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert sorted((r.term, r.id, r.len, r.tf) for r in rows.collect()) == [("a", 1, 3, 2), ("b", 1, 3, 1), ("b", 4, 2, 1), ("c", 4, 2, 1)]
    assert tuple(spark.read.parquet(str(tmp_path / "index" / "stats")).first()) == (4, 5 / 3)
    ranking.build_postings(docs.where("id = 3"), "id", F.col("text"), str(tmp_path / "none"))
    assert tuple(spark.read.parquet(str(tmp_path / "none" / "stats")).first()) == (1, 1e-9)


def test_tokens_of_every_character(spark):
    """The same as by scripts and classes alone."""
    from quern.functions.text import CJK, tokens

    c = F.decode(F.unhex(F.lpad(F.hex("id"), F.lit(8), F.lit("0"))), "UTF-32")
    texts = spark.range(0x110000).where("id not between 55296 and 57343").select(F.concat(F.lit("a"), c, F.lit("é"), c, c, F.lit("検")).alias("t"))
    plain = F.regexp_extract_all(F.lower("t"), F.lit(rf"[{CJK}]|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+"), F.lit(0))
    assert texts.where(tokens(F.col("t")) != plain).count() == 0
