"""Packing, filter audit and hard negatives against plain Python, on small and odd inputs."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import audit, negatives, packing, queries
from tests.compare import assert_same, connection
from tests.llm.test_text_operators import SCHEMA, corpus, frame

SPACES = ["a  b\t c", " lead", "trail ", "a\n\nb \n c", "日本 語の　文 \xa0x", "don't 's <|endoftext|> x<|endoftext|>", "\x1c x\x1dy", "x\x00y z", "\n\na", "é" * 300 + " " + "ab" * 4000]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(queries.BYTES)


def test_ids_are_those_of_the_tokenizer(whole):
    texts = ["", *SPACES, *(t or "" for t in corpus())]
    own = packing.Encoder(queries.BYTES, 2)
    assert own.ranked is not None
    for ranked in (own.ranked, None):
        own.ranked = ranked
        own.forget()
        for _ in range(2):  # the second time all chunks are known
            flat, at = own.encode(texts)
            assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CHUNKS", 20)
    own, texts = packing.Encoder(queries.BYTES, 2), corpus(4)
    for t in texts:
        flat, _ = own.encode([t or ""])
        assert flat.tolist() == whole.encode(t or "", add_special_tokens=False).ids + [2]


def histograms():
    rng = random.Random(5)
    yield {}, 0
    yield {340: 100_001}, 33_334
    yield {5: 3, 1000: 2}, 2
    yield {1: 5000}, 5
    yield {1023: 7, 1: 7}, 7
    yield {600: 10, 500: 10, 424: 10, 24: 10}, None
    yield Counter(rng.randint(1, 1023) for _ in range(3000)), None
    yield Counter(min(1023, int(rng.lognormvariate(5.3, 0.8)) + 1) for _ in range(20_000)), None


@pytest.mark.parametrize(("histogram", "best"), list(histograms()))
def test_plan_holds_all_pieces_in_few_sequences(histogram, best):
    plan = packing.solve(histogram, 1024)
    got = Counter()
    for row, times in plan:
        assert sum(k * n for k, n in row.items()) <= 1024
        got.update({k: n * times for k, n in row.items()})
    assert got == Counter(histogram)
    used, volume = sum(n for _, n in plan), sum(k * n for k, n in histogram.items())
    assert used == best if best is not None else used <= 1.02 * max(volume / 1024, sum(n for k, n in histogram.items() if k > 512)) + 1


def packed_as_promised(rows, texts, whole, width):
    by_text, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_text[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_text) == set(texts)
    for doc, text in texts.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_text[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // width)))
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert sum(r.length for r in pieces) == len(ids) and all(r.length == width for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert 0 < at <= width
    return len(by_sequence)


@pytest.mark.parametrize("width", [1024, 16])
def test_pack(spark, whole, width):
    texts = [*corpus(6), *SPACES, "word " * 9000]
    df = frame(spark, texts).repartition(5)
    rows = packing.pack(df, queries.BYTES, width).collect()
    n = packed_as_promised(rows, dict(enumerate(texts)), whole, width)
    total = sum(r.length for r in rows)
    assert n <= 1.03 * total / width + 2


def test_pack_documents(spark, small, whole):
    rows = queries.op11_packing(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert packed_as_promised(rows, texts, whole, 1024) <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_sequences_hold_the_ids(spark, whole):
    texts = corpus(7, 60)
    packed = packing.pack(frame(spark, texts), queries.BYTES, 64, ids=True)
    got = sorted(x for r in packing.sequences(packed).collect() for x in r.ids)
    assert got == sorted(x for t in texts for x in whole.encode(t or "", add_special_tokens=False).ids + [2])


def test_pack_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, queries.BYTES).count() == 0
    same = spark.createDataFrame([(None, None), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    rows = packing.pack(same.withColumn("length", F.lit("clash")).withColumn("task", F.lit(1)), queries.BYTES).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None", "None"] and sorted(r.length for r in rows) == [1, 3, 3, 3]
    assert len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows)[0] == 0


def fails(rows):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, part in rows:
        t = t or ""
        w = t.encode().split()
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        yield d, part or "", {k for k, v in own.items() if v}


def brute_audit(rows, labels):
    out, flagged = [], list(fails(rows))
    for part in {p for _, p, _ in flagged}:
        own = [(d, f) for d, p, f in flagged if p == part]
        removed = Counter()
        table = {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                hit = [d for d, x in own if f in x and not x & set(order[:k])]
                removed[f] += len(hit)
                table[order, k + 1] = (f, sum(not x & set(order[: k + 1]) for _, x in own), len(hit), sum(f in x for _, x in own) - len(hit), sum(x == {f} for _, x in own), *(sum(labels.get(d, {}).get(c) == 1 for d in hit) for c in ("quality", "toxic")))
        out += [(part, order, k, *rest, removed[f]) for (order, k), (f, *rest) in table.items()]
    return sorted(out)


def audit_texts():
    rng = random.Random(3)
    texts = corpus(8)
    texts += [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([90, 120, 300]))) + rng.choice(["", " $", " | #", " ABCDEF" * 30]) for _ in range(60)]
    return texts + texts[-20:] + ["x", "x", "", None, "A" * 100, "\n".join(f"a{k}" for k in range(30_000))]


@pytest.mark.parametrize("rows_of_a_range", [65_536, 7])
def test_audit(spark, rows_of_a_range, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_ROWS", rows_of_a_range)  # for the direct call below; workers keep their own
    rng = random.Random(2)
    rows = [(None if k % 41 == 0 else k // 2 if k % 29 == 0 else k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(audit_texts())]
    labels = {k: {"quality": rng.choice([0, 1, None]), "toxic": rng.choice([0, 1, None])} for k in range(0, len(rows), 2)}
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, part string, fails int").repartition(4)
    known = spark.createDataFrame([(k, v["quality"], v["toxic"]) for k, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = audit.interactions(docs, known)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    sums = defaultdict(lambda: np.zeros(6, np.int64))
    import pyarrow as pa

    own = sorted((p, sum(1 << "ABCDE".index(f) for f in x)) for _, p, x in fails(rows))
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in own]), pa.array([x for _, x in own]), *[pa.array([False] * len(own))] * 2], ["part", "fails", "good", "toxic"])
    for b in audit._merged(iter([batch.slice(0, 50), batch.slice(50)])):
        for r in b.to_pylist():
            sums[r["part"], r["filter"], r["before"]] += [r[c] for c in audit.COUNTS]
    assert len(sums) == 3 * 80 and all(v[0] == sum(p == k[0] for p, _ in own) for k, v in sums.items())


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = audit.interactions(spark.createDataFrame([(1, "a b", None, None, None, None, None)], SCHEMA), labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}


def test_lists():
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(4)]
        sets = [set(x.tolist()) for x in lists]
        assert audit.minus(lists[0], lists[1]).tolist() == sorted(sets[0] - sets[1])
        assert audit.union(lists).tolist() == sorted(set.union(*sets))


@pytest.mark.parametrize("name", ["op12_interactions", "op13_negatives"])
def test_same_as_sql(name, spark, small):
    assert_same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], connection(small))


def brute_negatives(rows, every, positives, negatives_, low, high):
    sound = [(i, lab, [int(np.floor(256 * float(c))) for c in v]) for i, lab, v in rows if None not in (i, lab, v) and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, own, x in sorted(sound):
        if a % every or any(o[0] == a for o in out if o[0] == a):
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=True))
        others = sorted(((-score(y), i, lab) for i, lab, y in sound if i != a and len(y) == len(x)))
        for s, i, _ in [o for o in others if o[2] == own][:positives]:
            band = [o for o in others if o[2] != own and -low * s <= -100 * o[0] <= -high * s]
            out += [(a, i, k + 1, o[1], -s, -o[0]) for k, o in enumerate(band[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("dims", [64, 13])
def test_negatives(spark, dims):
    rng = np.random.Generator(np.random.PCG64(dims))
    centre = rng.normal(0, 0.3, (4, dims))
    rows = [(i, int(rng.integers(0, 4)), (centre[int(rng.integers(0, 4))] + rng.normal(0, 0.15, dims)).tolist()) for i in range(300)]
    rows += [(400 + i, 1, rows[7][2]) for i in range(30)] + [(500, None, rows[0][2]), (501, 1, None), (502, 1, [float("nan")] * dims), (503, 1, [None] * dims), (504, 2, [float("inf")] * dims), (550, 2, []), (551, 2, []), (552, 3, [1.0, 2.0]), (None, 1, rows[0][2]), (600, 3, [100.0] * dims), (601, 2, [-70.0] * dims), (602, 1, [70.0] * dims), (650, 1, [0.0] * dims)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, label int, embedding array<double>, id string, dims int").repartition(3)
    for every, k, n in ((50, 5, 3), (7, 2, 40)):
        got = sorted(map(tuple, negatives.mine(df, every, k, n).collect()))
        assert got == brute_negatives(rows, every, k, n, 50, 95)
        assert got


def test_negatives_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(50, 1, [1.0, 0.0]), (50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.7, 0.0]), (2, 2, [0.7, 0.0])], schema)
    got = sorted(map(tuple, negatives.mine(twice, positives=1).collect()))
    assert got == [(50, 1, 1, 2, 65536, 256 * 179), (50, 1, 2, 2, 65536, 256 * 179)]
    alone = spark.createDataFrame([(50, 1, [1.0])], schema)
    assert negatives.mine(alone).count() == 0


def test_subset_sums_give_full_products():
    rng = np.random.Generator(np.random.PCG64(3))
    for dims, most in ((1, 5), (8, 200), (20, 1 << 30), (64, 127)):
        a, x = rng.integers(-most, most, (5, dims)), rng.integers(-most, most, (9, dims))
        assert (negatives.scores(negatives.tables(a), negatives.planes(x)) == x @ a.T).all()
