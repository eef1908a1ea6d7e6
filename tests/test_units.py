from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import chunking, globs, hygiene, markup
from quern.functions import text as X
from quern.operators import graphs, intervals, ranking, series, vectors
from quern.plans.usage import cost


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("BM25 检索 cache-first"))) == ["bm25", "检", "索", "cache", "first"]
    assert one(spark, X.tokens(F.lit(""))) == []


def test_term_counts_are_those_of_the_tokens(spark):
    texts = ["BM25 检索 cache-first cache", "Ünï_code ١٢ x²½ ﬁ 한글 かな", "", None, "a\u0301b Ⅷ a_b--c 検索", "İstanbul ẞ ΑΣ"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(2)
    want = df.select("id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.countDistinct("id").alias("df"), F.count("*").alias("tf"))
    got = X.term_counts(df.select(F.lower("text").alias("low")), "low")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_relative_floor(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 2.0), (3, 1.4), (4, 0.0)], "id int, score double")
    assert sorted(r.id for r in ranking.floor(rows, 0.15).collect()) == [1, 2]
    assert ranking.floor(rows, 0).count() == 4


def test_query_without_terms(spark):
    with pytest.raises(ValueError):
        ranking.query_terms(" -- ", spark)


def test_snippet(spark):
    long = "a" * 300 + " needle " + "b" * 300
    got = one(spark, X.snippet(F.lit(long), F.lit("needle"), F.array(F.lit("needle")), 40))
    assert "needle" in got and got.startswith("...") and got.endswith("...") and len(got) == 46
    assert one(spark, X.snippet(F.lit(" a  b "), F.lit("z"), F.array(F.lit("z")), 40)) == "a b"


def test_provider(spark):
    assert [one(spark, X.provider(F.lit(m))) for m in ("a/b", "b", "/b")] == ["a", "default", "default"]


def test_cache_bucket(spark):
    assert one(spark, hygiene.cache_bucket(F.lit(90), F.lit(10))) == "90_100"
    assert one(spark, hygiene.cache_bucket(F.lit(0), F.lit(0))) == "unknown"


def test_newest_version(spark):
    v = spark.createDataFrame([("v1.10.0",), ("v1.9.9",), ("1.0.0-rc1",), ("dev",)], "version string")
    assert series.newest_version(v).first()["newest"] == "v1.10.0"


def test_cost_without_cache_figures(spark):
    row = spark.createDataFrame([(1000, 0, 0, 0, 0)], "p int, h int, m int, w int, c int")
    assert row.select(cost("p", "h", "m", "w", "c", 1, 10, 40).alias("x")).first()["x"] == 10_000


def test_intervals_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, a, a + rng.randint(1, 30), rng.choice("xy")) for k in range(6) for a in (rng.randint(0, 200) for _ in range(25))]
    df = spark.createDataFrame(rows, "k int, start long, end long, layer string")

    def covered(k, layers):
        return {t for kk, a, b, x in rows if kk == k and x in layers for t in range(a, b)}

    length = {r.k: r.covered for r in intervals.union_length(df, ["k"]).collect()}
    left = {r.k: r.n for r in intervals.subtract(df.where("layer = 'x'"), df.where("layer = 'y'"), ["k"]).groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    first = {r.k: (r.x, r.y) for r in intervals.by_priority(df, ["k"], "layer", ["x", "y"]).collect()}
    for k in range(6):
        assert length[k] == len(covered(k, "xy"))
        assert left.get(k, 0) == len(covered(k, "x") - covered(k, "y"))
        assert first[k] == (len(covered(k, "x")), len(covered(k, "y") - covered(k, "x")))


def test_touching_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9)], "k int, start long, end long")
    assert [(r.start, r.end) for r in intervals.merge(df, ["k"]).collect()] == [(0, 9)]
    assert intervals.overlaps(df, ["k"]).first()["overlap"] is False


def test_percentile_and_upper_median(spark):
    df = spark.range(1, 11)
    assert df.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY id)").alias("p")).first()["p"] == 9
    assert df.agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY id)").alias("p")).first()["p"] == 10


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in vectors.topk(df, [2.0, 0.0], 5).collect()] == [(1, 1.0), (3, 0.707107)]
    assert vectors.topk(df, [0.0, 0.0], 5).count() == 0
    assert [vectors.candidates(k) for k in (1, 10, 40, 500)] == [6, 60, 200, 500]


def test_graphs(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "node long, up long")
    assert {r.node: r.depth for r in graphs.depths(links).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 9: 0}
    assert {r.node: r.root for r in graphs.roots(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "a long, b long")
    assert sorted(r.node for r in graphs.on_cycles(edges).collect()) == [1, 2, 3]


def reach(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
        to.setdefault(b, set())
    out = {}
    for n in to:
        seen, left = set(), list(to[n])
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += to[x]
        out[n] = seen
    return out


GRAPHS = {
    "two cycles that share a node": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6), (7, 1), (6, 8), (8, 8)],
    "a ring": [(i, (i + 1) % 50) for i in range(50)],
    "cycles one behind the other": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (7, 5), (1, 9), (9, 5)],
    "nothing but a tree": [(i // 2, i) for i in range(1, 60)],
    "dense": [(i, (i * i + 3) % 40) for i in range(40)] + [(i, (7 * i + 5) % 40) for i in range(0, 40, 2)] + [(i, i - 1) for i in range(1, 40, 7)],
    "double edges and loops": [(1, 1), (1, 2), (1, 2), (2, 3), (3, 3)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_strong_components(spark, name):
    edges = GRAPHS[name]
    to = reach(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    want = {n: min([n, *(m for m in to[n] if n in to[m])]) for n in to}
    assert {r.node: r.component for r in graphs.strong_components(df).collect()} == want
    assert {r.node for r in graphs.on_cycles(df).collect()} == {n for n in to if n in to[n]}


def test_long_tails_take_few_rounds(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(3000)] + [(3000, 1500), (3000, 9000), (0, 5000)] + [(i, i + 1) for i in range(5000, 7000)]
    df = spark.createDataFrame(edges, "a long, b long")
    rounds, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda x: rounds.append(1) or cut(x))
    got = {r.node: r.component for r in graphs.strong_components(df).collect()}
    assert all(got[n] == (1500 if 1500 <= n <= 3000 else n) for n in got) and len(got) == 5003
    assert len(rounds) < 120
    rounds.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(0, 2999)], "a long, b long")
    assert {r.node: r.layer for r in graphs.layers(chain).collect()} == {i: i for i in range(3001)}
    assert len(rounds) < 60


def test_order(spark):
    edges = [(5, 1), (5, 2), (1, 3), (2, 3), (9, 3), (3, 4), (20, 21), (21, 20), (21, 22), (30, 30), (30, 31)]
    nodes = [(n,) for n in (1, 2, 3, 4, 5, 9, 20, 21, 22, 30, 31, 7, 0)]
    rows = sorted(graphs.order(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(nodes, "node long")).collect(), key=lambda r: r.place)
    assert [r.node for r in rows] == [0, 5, 7, 9, 1, 2, 3, 4]
    assert [r.drain for r in rows] == list(range(8, 0, -1)) and [r.place for r in rows] == list(range(1, 9))


def test_globs():
    import re

    assert re.match(globs.glob_regex("src/**/*.py"), "src/a/b/c.py") and not re.match(globs.glob_regex("src/*.py"), "src/a/c.py")


def test_chunks_keep_lines():
    rng = random.Random(5)
    text = "\n".join("x" * rng.choice([0, 20, 400, 900, 7000]) for _ in range(80))
    lines = text.split("\n")
    last = 0
    for a, b, c in chunking.by_size(text):
        assert a > last or a == b == last  # slices of one long line
        assert c == "\n".join(lines[a - 1 : b]) or (a == b and c in lines[a - 1])
        assert len(c) <= 2 * 5750  # a long line is taken along before the chunk is closed
        last = b


def tree(found):
    return [(d.start, d.end, *([tree(d.members)] if d.members else [])) for d in found or []]


SOURCES = {
    ".py": (
        'import os\n\n@deco(\n    1)\ndef f(a,\n      b):\n    """doc\nno dedent\n"""\n    return "("\n\n# comment\nclass A:\n    x = {\n1: 2}\n    @property\n    def g(self):\n        pass\n\n    async def h(self):\n        pass\n\n\nif x:\n    def c():\n        pass\ny = 1\n',
        [(3, 10), (13, 21, [(16, 18), (20, 21)]), (25, 26)],
    ),
    ".js": (
        'import a from "b"\n// helper\n/* { */\nexport function f(x) {\n  const re = /[{"\']/g, t = `a ${ {b: 1} } {`;\n  if (x) {\n    return 1 / 2;\n  } else {\n    y()\n  }\n}\nconst o = { a: 1 };\n\nclass K extends B {\n  // m1\n  m1(a = "}") {\n    z()\n  }\n\n  m2() {\n    return \'\\\'{\';\n  }\n}\n',
        [(2, 11, [(6, 10)]), (14, 23, [(15, 18), (20, 22)])],
    ),
    ".go": ('package main\n\nimport (\n\t"fmt"\n)\n\n// S.\ntype S struct {\n\tn string\n}\n\nfunc (s *S) R() {\n\tq := `{`\n\tr := \'{\'\n}\n', [(3, 5), (7, 10), (12, 15)]),
    ".java": ('import y;\n\n/** doc { */\n@Anno\npublic class C {\n    int a;\n\n    @Override\n    public String s() {\n        return "x{";\n    }\n}\n', [(3, 12, [(8, 11)])]),
    ".rs": ("#[derive(Debug)]\nstruct S<'a> {\n    x: &'a str,\n}\n\nimpl<'a> S<'a> {\n    fn f() -> char {\n        '{'\n    }\n    fn g() {\n        r#\"{\"}\"#;\n    }\n}\n", [(1, 4), (6, 13, [(7, 9), (10, 12)])]),
    ".php": ("<?php\n# c {\nfunction f() {\n  $x = <<<EOT\n  { { {\nEOT;\n  return $x;\n}\n", [(2, 8)]),
    ".cpp": ('#define X {\nint f() {\n  auto s = R"x({)")x";\n  return 1\'000;\n}\n', [(1, 5)]),
}


@pytest.mark.parametrize("ext", SOURCES)
def test_declarations(ext):
    from quern.functions import declarations

    source, want = SOURCES[ext]
    assert tree(declarations.find(source, ext)) == want


def test_declarations_that_cannot_be_told():
    from quern.functions import declarations

    for source, ext in (("f() {\n", ".js"), ("}\n", ".java"), ("plain words", ".go"), ("", ".py"), ("def f():\n    pass", ".txt"), ("'", ".js"), ('"""', ".py"), ("/*", ".c")):
        assert declarations.find(source, ext) is None
        assert "".join(c for _, _, c in chunking.structural(source, declarations.find(source, ext))) in ("", source)


def whole_lines(text, got):
    lines, at = text.split("\n"), 1
    for a, b, piece in got:
        assert a == at and piece == "\n".join(lines[a - 1 : b])
        at = b + 1
    assert at == len(lines) + 1


def test_structural_chunks_keep_methods_whole():
    from quern.functions import declarations

    rng = random.Random(3)
    for _ in range(60):
        body = lambda: "".join("    " * 2 + "x" * rng.randint(1, 60) + " = 1\n" for _ in range(rng.choice([1, 5, 20, 60])))
        parts = [rng.choice(["import a\n\n", f"def f{k}():\n{body()}\n", f"class C{k}:\n" + "".join(f"    def m{j}(self):\n{body()}\n" for j in range(rng.randint(1, 6)))]) for k in range(rng.randint(1, 8))]
        text = "".join(parts)
        found = declarations.find(text, ".py")
        if not found:
            continue
        got = chunking.structural(text, found)
        whole_lines(text, got)
        lines = text.split("\n")
        assert all(len(piece) <= 2000 + 60 for _, _, piece in got)  # a residue may join what is full
        assert len(got) == 1 or all(len(piece) >= 49 for _, _, piece in got)
        for d in [x for d in found for x in (d, *d.members)]:
            if sum(map(len, lines[d.start - 1 : d.end])) + d.end - d.start + 1 <= 2000:
                assert any(a <= d.start and d.end <= b for a, b, _ in got)
    small = "".join(f"def f{k}():\n    return {k}\n\n" for k in range(40))
    assert len(chunking.structural(small, declarations.find(small, ".py"))) == 1  # small ones share a piece


def test_go_symbols():
    from quern.functions import declarations

    source = "package m\n\ntype S[T any] struct {\n\tn T\n}\ntype (\n\tID int\n\tOpt interface {\n\t\tDo()\n\t}\n)\nconst A, B = 1, 2\nvar (\n\tx = map[string]int{\n\t\t\"a\": 1,\n\t}\n\ty int\n)\nfunc (s *S[T]) Run(c C) error {\n\tvar z = 1\n}\nfunc Map[K any](k K) {}\nfunc (pkg.T) Odd() {}\n// func no() {}\n"
    got = [(n, k, at, parent) for n, k, at, parent, _ in declarations.go_symbols(source)]
    assert got == [("S", "struct", 3, ""), ("ID", "type", 7, ""), ("Opt", "interface", 8, ""), ("A", "const", 12, ""), ("B", "const", 12, ""), ("x", "var", 14, ""), ("y", "var", 17, ""), ("Run", "method", 19, "S"), ("Map", "func", 22, ""), ("Odd", "method", 23, "T")]


def test_markup():
    page = "<title>T</title><script>x</script><h2>Head</h2><p>One <a href='/u'>two</a>, three&nbsp;&lt;<ul><li>a<li>b</ul><pre>k  k</pre><table><tr><td>1<td>2</table>"
    assert markup.to_text(page) == "# T\n\n## Head\n\nOne two (/u), three <\n\n- a\n- b\n\n```\nk  k\n```\n\n1 | 2"


def test_scrub(spark):
    key = "sk-" + "proj-" + "a1" * 10
    cases = {
        "mail a.b@c.org, token=abc123, /home/joe/x, C:\\Users\\Joe Smith": "mail [redacted-email], token=[redacted], /home/_/x, C:\\Users\\_ Smith",
        "Authorization: Bearer " + "x" * 20 + ' PASSWORD="p q" refresh_token: z': 'Authorization=[redacted] PASSWORD=[redacted] q" refresh_token=[redacted]',
        "bearer " + "y" * 16: "Bearer [redacted]",
        f"use {key} now": "use [redacted-key] now",
        "f" * 40 + " " + "eyJhb-x.eyJz.s_g": "[redacted-hex] [redacted-jwt]",
        "Zq" * 20 + "/" + " x": "[redacted-token] x",
        "nothing here": "nothing here",
    }
    for text, want in cases.items():
        assert one(spark, hygiene.scrub(F.lit(text))) == want, text


def test_masks(spark):
    cases = {"sk-" + "a" * 20: "sk-aaa" + "*" * 13 + "aaaa", "ghp_" + "b" * 30: "ghp_" + "*" * 26 + "bbbb", "short": "****"}
    for secret, want in cases.items():
        assert one(spark, hygiene.mask(F.lit(secret))) == want
    text = "api key: abcdefghijkl, ****ae54, sk-ab****, opaque 0123456789abcdefg, lowercaseonlyidentifier, MixedCaseIdentifierX, CONSTANT_LIKE_THIS_ONE"
    assert one(spark, hygiene.scrub_credentials(F.lit(text))) == "api key: ****, ****, ****, opaque ****, lowercaseonlyidentifier, ****, CONSTANT_LIKE_THIS_ONE"


def test_report_flags(spark):
    flag = lambda c: one(spark, c)
    assert flag(hygiene.is_development(F.lit(" DEV "), F.lit("v1"))) and flag(hygiene.is_development(F.lit("x"), F.lit("dev-3"))) and not flag(hygiene.is_development(F.lit("x"), F.lit("v1")))
    assert flag(hygiene.is_no_crash(F.lit("ResizeObserver loop limit exceeded"))) and flag(hygiene.is_no_crash(F.lit("Minified React error #520; x"))) and not flag(hygiene.is_no_crash(F.lit("Minified React error #5201")))
    assert flag(hygiene.is_opaque(F.lit("crash"), F.lit("Script error. "), F.lit(" "))) and not flag(hygiene.is_opaque(F.lit("crash"), F.lit("Script error."), F.lit("main.js")))


def test_counter_stops_at_zero_at_every_step(spark):
    from pyspark.sql import Window

    from quern.plans.writes import floored

    rng = random.Random(2)
    steps = [(0, i, s) for i, s in enumerate([-1, 1])] + [(k, i, rng.choice([-1, 1])) for k in range(1, 30) for i in range(rng.randint(1, 12))]
    want = {}
    for k, _, s in steps:
        want[k] = max(0, want.get(k, 0) + s)
    df = spark.createDataFrame(steps, "k int, i int, d int").withColumn("s", F.sum("d").over(Window.partitionBy("k").orderBy("i")))
    assert {r.k: r.x for r in df.groupBy("k").agg(floored(F.sum("d"), F.min("s")).alias("x")).collect()} == want and want[0] == 1


def test_versioned_table(spark, tmp_path):
    from quern.operators.versioned import Conflict, RollUp, VersionedTable

    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        t.read()
    rows = lambda x: spark.createDataFrame(x, "k string, n long")
    got = lambda: sorted(map(tuple, t.read().select("k", "n").collect()))
    t.replace(rows([("a", 1), ("b", 2)]))
    before = t.read()
    t.upsert_add(rows([("b", 3), ("c", 4)]), ["k"], "n")
    assert got() == [("a", 1), ("b", 5), ("c", 4)] and sorted(map(tuple, before.collect())) == [("a", 1), ("b", 2)]
    t.insert_new(rows([("a", 9), ("d", 9)]), ["k"]).replace_keys(rows([("b", 7), ("b", 8)]), ["k"]).keep("k <> 'c'")
    assert got() == [("a", 1), ("b", 7), ("b", 8), ("d", 9)] and len(t.versions()) == 5
    assert t.expire().read().count() == 4
    # Files that no log row names are not seen: a write that died.
    rows([("z", 1)]).write.parquet(str(tmp_path / "t" / "v9-dead"))
    assert got()[-1] == ("d", 9)

    roll = RollUp(spark, str(tmp_path / "r"))
    seen = spark.createDataFrame([("s1", "x", 1), ("s1", "x", 1), ("s1", "y", 2), ("s2", "x", 3), ("s3", "x", 4)], "signal string, bucket string, install_id long")
    assert [roll.refresh(seen, ["s1", "s2", "s3"], 2) for _ in range(3)] == [["s1", "s2"], ["s3", "s1"], ["s2", "s3"]]
    assert sorted(map(tuple, roll.read().collect())) == [("s1", "x", 1), ("s1", "y", 1), ("s2", "x", 1), ("s3", "x", 1)]
    roll.refresh(seen.where("signal <> 's1'"), ["s1", "s2", "s3"], 1)  # a signal that has become empty
    assert sorted(r.signal for r in roll.read().collect()) == ["s2", "s3"]

    # Two writers that begin with the same version: one of them is told, and nothing is lost.
    known = t.versions()[-1][0]
    t.replace(rows([("w", 1)]))
    with pytest.raises(Conflict):
        t.replace(rows([("x", 1)]), after=known)
    assert got() == [("w", 1)]
    late = iter([lambda: t.replace(rows([("y", 1)]))])
    t.change(lambda old: (next(late, lambda: None)(), old.unionByName(rows([("z", 1)])))[1])
    assert got() == [("y", 1), ("z", 1)]


def test_index_writes_only_what_has_changed(spark, tmp_path, monkeypatch):
    import os

    from quern.operators.versioned import BucketTable, sync

    index = BucketTable(spark, ["path"], str(tmp_path / "i"), buckets=8)
    files = lambda x: spark.createDataFrame(x, "path string, h string")
    actions = lambda x, **k: {r.path: r.action for r in sync(index, files(x), "path", "h", **k).collect()}
    on_disk = lambda: {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "i") for f in names if f.startswith("part-")}
    assert actions([("a", "1"), ("b", "1")]) == {"a": "insert", "b": "insert"}
    assert actions([("a", "1"), ("b", "2"), ("c", "1")]) == {"a": "unchanged", "b": "update", "c": "insert"}
    assert actions([("c", "1")]) == {"a": "delete", "b": "delete", "c": "unchanged"}
    assert sorted(map(tuple, index.read().select("path", "h").collect())) == [("c", "1")]
    many = [(f"f{i}", str(i)) for i in range(100)]
    actions(many)
    before, versions = on_disk(), len(index.entries())
    assert set(actions(many).values()) == {"unchanged"}
    assert on_disk() == before and len(index.entries()) == versions
    actions([("f7", "new"), *(m for m in many if m[0] != "f7")])
    new = on_disk() - before
    assert len({os.path.dirname(f) for f in new}) == 1 and len(index.entries()) == versions + 1
    assert index.read().where("h = 'new'").count() == 1 and index.read().count() == 100
    # A run that dies half-way goes on with the buckets that it has not committed.
    commit, left = index._commit, [2]

    def dying(*args):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("gone")
        commit(*args)

    monkeypatch.setattr(index, "_commit", dying)
    later = [(p, h + "x") for p, h in many]
    with pytest.raises(RuntimeError):
        actions(later, step=2)
    monkeypatch.undo()
    again = list(actions(later, step=2).values())
    assert 0 < again.count("unchanged") < 100 and again.count("update") == 100 - again.count("unchanged")
    assert sorted(map(tuple, index.read().select("path", "h").collect())) == sorted(later)
    assert index.expire().read().count() == 100
    assert actions([]) == {p: "delete" for p, _ in many} and index.read().count() == 0


def test_paths(spark):
    from quern.functions import paths

    rows = {"a/b.py": True, ".git/x.py": False, "a/.hidden.py": False, "node_modules/x.js": False, "a/build/x.c": False, "logs/x.py": False, "a/logs/x.py": False, "top.py": False, "a/top.py": True, "x.tmp.py": False, "docs/y/z.md": False, "docs/z.md": False, "builder/x.c": True}
    df = spark.createDataFrame(list(rows.items()), "path string, want boolean")
    got = {r.path: r.x for r in df.select("path", paths.walked(F.col("path"), ["logs/", "/top.py", "*.tmp.py", "docs/**/z.md"]).alias("x")).collect()}
    assert got == rows
    sized = {("a.py", 1): True, ("a.py", 0): False, ("a.py", 1 << 20): True, ("a.py", (1 << 20) + 1): False, ("A.PY", 5): True, ("a.min.js", 5): False, ("d/yarn.lock", 5): False, ("x.pb.go", 5): False, ("a.bin", 5): False, ("Makefile", 5): False}
    df = spark.createDataFrame([(*k, v) for k, v in sized.items()], "path string, n long, want boolean")
    assert {(r.path, r.n): r.x for r in df.select("path", "n", paths.indexable(F.col("path"), F.col("n")).alias("x")).collect()} == sized
    assert one(spark, paths.written_by_hand(F.lit("x" * 400))) and not one(spark, paths.written_by_hand(F.lit("x" * 401))) and not one(spark, paths.written_by_hand(F.lit("a\n" * 100 + "x" * 5001)))


def test_encodings():
    from quern.functions import encodings

    for text in ("plain", "größe – 検索"):
        for codec, name in (("utf-8", "utf-8"), ("utf-8-sig", "utf-8-bom"), ("gb18030", "gb18030")):
            want = "utf-8" if text == "plain" and codec == "gb18030" else name
            assert encodings._read(text.encode(codec)) == (want, text)
        assert encodings._read(b"\xff\xfe" + text.encode("utf-16-le")) == ("utf-16le", text)
    assert encodings._read(b"a\0b") == ("binary", None) and encodings._read(None) == (None, None) and encodings._read(b"\xff\x81\x20")[0] == "lossy-utf-8"


def test_sections(spark):
    from quern.functions import markdown

    text = "intro\n# A #\ntext\n### C\n```\n# no heading\n```\n## B\nmore\n##### five\n#\n#none\n# Z\nend"
    rows = markdown.sections(spark.createDataFrame([("d", text), ("e", "no heads"), ("f", " \n ")], "k string, text string"), "k", "text").orderBy("k", "section").collect()
    assert [(r.k, r.section, r.level, r.trail, r.start_line, r.end_line) for r in rows] == [("d", 0, 0, "A", 1, 1), ("d", 1, 1, "A", 2, 3), ("d", 2, 3, "A > C", 4, 7), ("d", 3, 2, "A > B", 8, 12), ("d", 4, 1, "Z", 13, 14), ("e", 0, 0, "", 1, 1)]
    many = "\n".join(f"# h{i}" if i % 2 else "x" for i in range(10_011))
    assert markdown.sections(spark.createDataFrame([(0, many), (1, many)], "k long, text string"), "k", "text").groupBy("k").count().select("count").distinct().first()[0] == 5006


def test_symbols(spark):
    from quern.functions.symbols import declaration

    cases = {
        ("class A(B):", ".py"): ("A", "class"), ("  async def f(x):", ".py"): ("f", "func"), ("def f:", ".py"): None, ("export default abstract class A {", ".ts"): ("A", "class"), ("const f = (a) => a", ".js"): ("f", "func"),
        ("const f = 3", ".js"): None, ("public sealed interface I {", ".java"): ("I", "interface"), ("  private static int f(int a) {", ".java"): ("f", "method"), ("pub(crate) trait T {", ".rs"): ("T", "trait"), ("static int main(void) {", ".c"): ("main", "func"), ("int f(void);", ".c"): None, ("class A", ".md"): None,
    }
    rows = spark.createDataFrame(list(cases), "line string, ext string").select("line", "ext", declaration(F.col("line"), F.col("ext")).alias("d")).collect()
    assert {(r.line, r.ext): tuple(r.d) if r.d else None for r in rows} == cases


def test_line_tallies():
    from quern.functions import linediff

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return len(b) - table[-1][-1], len(a) - table[-1][-1]

    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert linediff.tally("\n".join(a), "\n".join(b)) == (False, *plain(linediff.lines_of("\n".join(a)), linediff.lines_of("\n".join(b))))
    assert linediff.tally("a\0", "b") == (True, 0, 0) and linediff.tally("", "a\n") == (False, 1, 0) and linediff.tally("x", "x") == (False, 0, 0)
    long = [str(i) for i in range(1500)]
    assert linediff.tally("\n".join(long), "\n".join(reversed(long))) == (False, 0, 0)  # too many changes: order is not looked at


def test_text_helpers(spark):
    family = "👨‍👩‍👧"
    assert one(spark, X.clip(F.lit(family * 3 + "e\u0301x"), 5)) == family * 3 + "e\u0301x" and one(spark, X.clip(F.lit(family * 4), 3)) == family * 2 + "…" and one(spark, X.clip(F.lit("a\nb\nc"), 3)) == "a\n…"
    label = lambda n: one(spark, X.tick_label(F.lit(float(n))))
    assert [label(n) for n in (3, 1000, 1500, 2_000_000, 2_500_000)] == ["3", "1k", "1.5k", "2m", "2.5m"]
    step = lambda n: one(spark, X.tick_step(F.lit(float(n)), 4))
    assert [step(n) for n in (3, 4, 10, 45, 170)] == [1, 1, 5, 20, 50]
    language = lambda t: one(spark, X.document_language(F.lit(t)))
    assert [language(t) for t in ("検" * 101, "検" * 100, "検" * 101 + "a" * 405, "a")] == ["zh-CN", "en", "en", "en"]


def test_strong_matches(spark):
    from quern.operators import ranking

    assert ranking.is_generic("  Please   continue ") and ranking.is_generic("继续") and not ranking.is_generic("continue now")
    assert ranking.distinctive("why does myFunc fail", "myfunc") and ranking.distinctive("see #nation", "nation") and ranking.distinctive("in conf_x", "conf_x") and not ranking.distinctive("the order", "order")
    cases = [("a b c", ["a", "b", "c"], ["a", "b"], True), ("a b c", ["a", "b", "c"], ["a"], False), ("x long-one", ["x", "longer"], ["longer"], True), ("x longer y", ["x", "longer", "y"], ["longer"], False), ("検索語", ["検", "索", "語"], ["検", "索"], False), ("検索語", ["検", "索", "語"], ["検", "索", "語"], True), ("x myFunc y", ["x", "myfunc", "y"], ["myfunc"], True)]
    for query, terms, matched, want in cases:
        got = one(spark, ranking.strong_match(query, terms, F.array(*map(F.lit, matched))))
        assert bool(got) is want, query


def recall(found, true):
    found, true = ({(r.query, r.id) for r in x} for x in (found, true))
    return len(found & true) / len(true)


def test_index_reads_few_rows(spark, tmp_path):
    import numpy as np

    from quern.operators import ann, pq
    from quern.sources.tables import table

    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    q, n = e.where("vec_id % 50 = 0"), e.count()
    model = pq.fit(e)
    assert len(model.centres) <= 1.5 * n**0.5
    pq.build(e, str(tmp_path / "index"), model)
    codes = spark.read.parquet(str(tmp_path / "index" / "codes"))
    assert codes.agg(F.sum("rows")).first()[0] == n
    true = ann.exact(e, q, 10).collect()
    found = pq.search(str(tmp_path / "index"), e, q, 10).collect()
    assert recall(found, true) >= 0.9 and 10 * 10 <= n / 10  # a hundred vectors are read for each query
    assert {(r.query, r.id): r.score for r in found}.items() <= {(r.query, r.id): r.score for r in ann.exact(e, q, n).collect()}.items()
    assert all(r.place == 1 for r in found if r.query == r.id)


def test_index_of_clusters_reads_few_codes(spark, tmp_path):
    """Where rows lie in clusters, a tenth of the lists hold their neighbours; copies of one row are cut into blocks."""
    import numpy as np

    from quern.operators import ann, pq

    rng = np.random.Generator(np.random.PCG64(2))
    centre = rng.normal(0, 1, (60, 24))
    x = [*(centre[i % 60] + rng.normal(0, 0.15, 24) for i in range(4000)), *[centre[0]] * 9000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    e = spark.createDataFrame([*rows, (-1, [1.0]), (-2, None), (None, rows[0][1]), (-3, [0.0] * 24), (-4, [float("nan")] * 24)], "vec_id long, embedding array<double>")
    model = pq.fit(e)
    assert model.dims == 24 and model.probes <= len(model.centres) / 10 + 1
    pq.build(e, str(tmp_path / "index"), model)
    codes = spark.read.parquet(str(tmp_path / "index" / "codes"))
    assert codes.agg(F.sum("rows"), F.max("rows")).first()[0] == len(rows) and codes.agg(F.max("rows")).first()[0] <= pq.BLOCK
    q = e.where("vec_id >= 0 and vec_id < 4000 and vec_id % 60 between 1 and 9 and vec_id % 7 = 0 or vec_id < 0")
    found = pq.search(str(tmp_path / "index"), e, q, 10).collect()
    assert recall(found, ann.exact(e.where("size(embedding) = 24"), q.where("size(embedding) = 24"), 10).where("score is not null and not isnan(score)").collect()) >= 0.9
    assert pq.fit(e.limit(0)) is None


def test_exact_search_by_brute_force(spark):
    import numpy as np

    from quern.operators import ann
    from quern.sources.tables import table

    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    exact = {(r.query, r.id) for r in ann.exact(e, e.where("vec_id % 50 = 0"), 10).collect()}
    x = np.array([r.embedding for r in e.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(i, int(j)) for i in range(0, len(x), 50) for j in np.lexsort((np.arange(len(x)), -np.round(x[i] @ x.T, 6)))[:10]}
    assert exact == want
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query, r.id) for r in ann.exact(odd, odd, 2).collect()) == [(1, 1), (1, 6), (5, 5), (6, 1), (6, 6)]


def test_embedded_search_against_brute_force(spark, small):
    import numpy as np

    from quern.functions import models
    from quern.plans.outcomes import embedded_search
    from quern.sources.tables import table

    model, second = models.HashEmbedder(64), models.OverlapReranker()
    docs = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, small, "benchmark").where("text is not null").collect()}
    ids = sorted(docs)
    x = model.embed([docs[i].text or "" for i in ids]).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = set()
    for item, text in items.items():
        q = model.embed([text])[0].astype(float)
        score = np.round(x @ (q / np.linalg.norm(q)), 6)
        near = np.lexsort((ids, -score))[:60]
        rows = [(-second.rerank(text, [docs[ids[k]].text])[0], -score[k], ids[k]) for k in near if docs[ids[k]].source.startswith("src1")]
        want |= {(item, d) for *_, d in sorted(rows)[:10]}
    got = {(r.query, r.id) for r in embedded_search(spark, small).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)  # sums in another order may swap equal scores


def test_layers(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (5, 4), (7, 8), (8, 7), (8, 9), (4, 4)], "a long, b long")
    assert {r.node: r.layer for r in graphs.layers(edges).collect()} == {1: 0, 5: 0, 2: 1, 3: 2, 4: 3}


def test_series_of_counts(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 9)) for k in range(4) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "k int, v int")
    own = {k: sorted(v for q, v in rows if q == k) for k in range(4)}
    assert {r.k: r.median for r in series.upper_median(df, ["k"], "v").collect()} == {k: v[len(v) // 2] for k, v in own.items()}
    assert {r.k: r.p for r in series.percentiles(df, ["k"], "v", {"p": 90}).collect()} == {k: v[-(-90 * len(v) // 100) - 1] for k, v in own.items()}


def test_a_source_without_events(spark, tmp_path):
    from quern.streaming import runs

    spark.createDataFrame([], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    stream = runs.event_stream(spark, str(tmp_path))
    assert runs.merge_counters(stream, ["event_type"]).count() == 0


def test_jsonl_days(spark, tmp_path):
    from quern.sources import jsonl

    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "d string, n long").select(F.to_timestamp("d").alias("ts"), "n")
    path = str(tmp_path / "log")
    jsonl.append_days(rows, path)
    jsonl.append_days(rows, path)
    with open(f"{path}/day=2024-01-02/torn.json", "w") as f:
        f.write('{"ts":"2024-01-02T00:00:00.000Z","n":5}\n{"n": ')
    assert sorted(r.n for r in jsonl.read_days(spark, path, "ts timestamp, n long", "2024-01-02", "2024-01-03").collect()) == [2, 2, 3, 3, 5]
    log = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}'), (3, "{oops"), (4, '{"a": 4}')], "seq long, raw string")
    assert [r.seq for r in jsonl.until_damage(log, "seq", "raw", "a long").orderBy("seq").collect()] == [1, 2]


def test_vector_store(spark, tmp_path):
    from quern.sources import vector_store as store

    path, made_by = str(tmp_path / "store"), store.recipe(3, "m", 2)
    first = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 1.0]), ("b", [1.0])], "path string, vec array<float>")
    store.write(first, path, made_by)
    store.write(spark.createDataFrame([("a", [2.0, 2.0])], "path string, vec array<float>"), path, made_by)
    assert store.stats(store.read(spark, path, made_by, 2)).first().asDict() == {"paths": 2, "chunks": 2}
    assert store.read(spark, path, store.recipe(4, "m", 2), 2).count() == 0


def test_embedding_batches():
    from quern.functions import models

    assert [len(b) for b in models.batches(["x" * 40] * 25, count=10)] == [10, 10, 5]
    assert [len(b) for b in models.batches(["x" * 400] * 3, tokens=250)] == [2, 1]
    near, far = models.HashEmbedder(64).embed(["a b c d", "a b c e"]), models.HashEmbedder(64).embed(["q r s t"])
    assert float(near[0] @ near[1]) > float(near[0] @ far[0])


def test_streams_carry_state(spark, tmp_path):
    from quern.streaming import runs

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    parts = [[(1, 1, "view"), (2, 1, "signup"), (3, 2, "signup")], [(4, 1, "view"), (5, 1, "signup"), (6, 2, "view")]]
    folder = tmp_path / "events"
    for part in parts:
        rows = [(i, None, u, k, 1.0, "{}") for i, u, k in part]
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = runs.latest_update(runs.updates(runs.turn_counters(stream)), ["user_id", "turn"], "n")
    assert sorted(map(tuple, got.select("user_id", "turn", "n").collect())) == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (2, 1, 2)]
