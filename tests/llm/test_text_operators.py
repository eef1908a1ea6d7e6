"""Operators on texts against plain Python on small and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import components, decontaminate, exchange, fertility, jaccard, languages, pieces, privacy, quality, queries, repeats, toxicity, webtext
from quern.llm import textpack as tp
from quern.llm.signature import SignatureTree

VOCABULARIES = queries.PIECES, queries.RANKS, public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"
ODD = [None, "", " ", "\n\t", "one", "a b c", "é à ö ü", "日本語 の 文", "x" * 5000, "A\x00B c", "▁ ▁x", "a\x0bb\x0cc\xa0d", "don't STOP", "ÀÉ straße"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None if i % 5 == 0 else "en", "s", 1, 0.5, "clash") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=1, n=120):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "s", "ing", "x", "y"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(n // 3)]
    passage = [word() for _ in range(30)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w += passage
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    rng.shuffle(texts)
    return texts + ODD + texts[:3]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words_and_windows():
    texts = corpus()
    for classes, pattern, low in ((tp.SPACE_WORDS, r"[^\x20\x09-\x0D]+", False), (tp.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = tp.split(pa.array(texts, pa.string()), classes, low)
        raw = w.buf.tobytes()
        got = [[raw[a:b].decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
        want = [re.findall(pattern, lower(t) if low else t or "") for t in texts]
        assert got == want
        seen = {}
        for words, h in zip([x for ws in want for x in ws], w.hash.tolist(), strict=True):
            assert seen.setdefault(words, h) == h
        assert len(set(seen.values())) == len(seen)
        at, h = w.windows(3)
        assert len(at) == sum(max(0, len(x) - 2) for x in want)


@pytest.mark.parametrize("block", [400_000, 7])
def test_decontaminate(spark, block):
    texts = corpus(2)
    items = [("i1", " ".join(split(texts[5])[:14])), ("i2", "alpha betas"), ("i3", None), ("i4", ""), (None, "gamma"), ("i1", "kappa kappax"), ("i10", texts[9]), ("i2", "alpha betas")]
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.digest(decontaminate.decontaminate(frame(spark, texts), bench, block_windows=block)).collect()))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {(i, tuple(w[k : k + n])) for i, t in items if i and t for w in [words(t)] if w for n in [min(10, len(w))] for k in range(len(w) - n + 1)}
    want = []
    for d, t in enumerate(texts):
        w = words(t)
        hit, ids = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert got == want


def test_decontaminate_empty_tables(spark):
    none = frame(spark, []), spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.digest(decontaminate.decontaminate(*none)).count() == 0
    assert decontaminate.digest(decontaminate.decontaminate(frame(spark, ["a b"]), none[1])).first()["contaminated"] is False


def links(texts, width=5):
    sets = []
    for t in texts:
        w = split(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard(spark, block):
    texts = corpus(3, 150)
    base = " ".join(f"w{i}" for i in range(60))
    texts += [base.replace(f"w{i} ", f"v{i} ") for i in range(1, 30)] + [base.replace(f"w{i} ", f"v{i} ").replace(f"w{i + 9} ", "u ") for i in range(1, 30)]
    got = sorted(map(tuple, jaccard.join(frame(spark, texts), block_sets=block, links=False).collect()))
    assert got == links(texts)


@pytest.mark.parametrize("block", [7, 512])
def test_jaccard_counts_every_link(spark, block):
    texts = corpus(3, 150)
    base = " ".join(f"w{i}" for i in range(60))
    texts += [base.replace(f"w{i} ", f"v{i} ") for i in range(1, 30)] + [base] * 3
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = [sum(i != j and bool(a) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard.join(frame(spark, texts), block_sets=block, links=True)
    assert [r.n_links for r in got.orderBy("doc_id").collect()] == want and max(want) > 20
    assert sorted(map(tuple, got.drop("n_links").collect())) == links(texts)


def test_jaccard_odd_rows(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    rows = jaccard.join(frame(spark, ["a b c d e f g", "a b c d e f g"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in rows] == [(None, 3, None)] * 2


def test_signature_tree_finds_all_components():
    r = np.random.default_rng(1)
    for _ in range(25):
        sets = []
        for b in [np.unique(r.integers(0, 2**63, r.integers(1, 120), dtype=np.uint64)) for _ in range(r.integers(1, 12))]:
            for _ in range(r.integers(1, 25)):
                x = np.concatenate([b[r.random(len(b)) < r.choice([1, 0.97, 0.9, 0.85])], r.integers(0, 2**63, r.integers(0, 1 + len(b) // 8), dtype=np.uint64)])
                sets.append(np.unique(x if len(x) else b))
        got = SignatureTree(sets).traverse()
        up = list(range(len(sets)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
        assert len({(int(got[i]), root(i)) for i in range(len(sets))}) == len({int(g) for g in got}) == len({root(i) for i in range(len(sets))})


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize(("group", "bits"), [(1 << 19, repeats.LABEL_BITS), (40, repeats.LABEL_BITS), (1 << 19, 8), (40, 1)])
def test_repeats(spark, group, bits):
    """Also with labels so short that they collide all the time."""
    texts = corpus(6, 150)
    got = sorted(map(tuple, repeats.remove(frame(spark, texts), texts=False, group=group, bits=bits).collect()))
    least: dict = {}
    for d, t in enumerate(texts):
        w = split(t)
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, t in enumerate(texts):
        w = split(t)
        gone = {k for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == want
    full = repeats.remove(frame(spark, texts), texts=True).collect()
    assert {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in full} == {d: h for d, _, _, h in want}
    assert all(sum(r.removed_spans[1::2]) - sum(r.removed_spans[::2]) == r.n_removed for r in full)


def test_repeats_odd_rows(spark):
    assert repeats.remove(frame(spark, [])).count() == 0
    same = frame(spark, [" ".join(map(str, range(20)))] * 2)
    assert {r.n_removed for r in repeats.remove(same.withColumn("doc_id", F.lit(None).cast("long"))).collect()} == {0}
    assert {r.n_removed for r in repeats.remove(same.withColumn("doc_id", F.lit(5).cast("long"))).collect()} == {0}


def test_pieces(spark):
    texts = corpus(7) + ["<s> </s>", "ａ ﬁ é", "😀 👍🏽", " lead", "trail  "]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    encoded = pieces.encode(frame(spark, texts), queries.PIECES)
    for r in encoded.collect():
        t = texts[r.doc_id] or ""
        ids = sp.encode(t)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        if ids:
            assert r.begins[0] == 0 and r.ends[-1] == len(t.encode()) and r.begins[1:] == r.ends[:-1]
            raw = t.encode()
            for i, a, b in zip(ids, r.begins, r.ends, strict=True):
                if not sp.is_byte(i) and "▁" not in t:
                    assert raw[a:b].decode() in (sp.id_to_piece(i).replace("▁", " "), sp.id_to_piece(i)[1:].replace("▁", " "))  # the very first mark has no source
    assert {r.doc_id: r.decoded for r in pieces.decode(encoded, queries.PIECES).collect()} == {r.doc_id: r.decoded for r in encoded.collect()}


def test_pieces_query_gives_spans(spark, small):
    rows = queries.op2_pieces(spark, small)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows.select("doc_id", "n_tokens", "ids", "begins", "ends").collect():
        assert len(r.ids) == len(r.begins) == len(r.ends) == r.n_tokens
        assert b"".join(texts[r.doc_id][a:b] for a, b in zip(r.begins, r.ends, strict=True)) == texts[r.doc_id]
    with open(queries.PIECES, "rb") as f:
        normalize = pieces.Coder(f.read()).normalize
    assert normalize.identity
    for text in (" a  é▁😀 ", "", " ", "x"):
        fast = normalize(text.encode())
        normalize.identity = False  # byte by byte, as with a character map
        slow = normalize(text.encode())
        normalize.identity = True
        assert fast[0] == slow[0] and fast[1].tolist() == slow[1].tolist()


def charsmap(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map in the layout that the models use."""
    strings, value = b"", {}
    for new in rules.values():
        if new not in value:
            value[new] = len(strings)
            strings += new + b"\0"
    units = {0: 0}
    taken, bases = {0}, set()

    def place(pos, words):
        kids = sorted({w[0] for w in words if w})
        leaf = b"" in words
        base = next(b for b in range(1, 1 << 20) if b not in bases and all(b ^ c not in taken for c in [*kids, *([0] if leaf else [])]))
        bases.add(base)  # nodes with one base could not be told apart
        taken.update(base ^ c for c in [*kids, *([0] if leaf else [])])
        units[pos] = units[pos] | (pos ^ base) << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = 1 << 31 | value[words[b""]]
        for c in kids:
            units[base ^ c] = c
            place(base ^ c, {w[1:]: v for w, v in words.items() if w and w[0] == c})

    place(0, rules)
    array = np.zeros(-(-(max(units) + 1) // 256) * 256, "<u4")  # as the library wants it
    for k, v in units.items():
        array[k] = v
    return len(array.tobytes()).to_bytes(4, "little") + array.tobytes() + strings


def test_character_map_keeps_alignment():
    class Spec:
        precompiled_charsmap = charsmap({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"X", "　".encode(): b" "})
        add_dummy_prefix = True
        remove_extra_whitespaces = True

    norm, align = pieces.Normalizer(Spec)("  abaﬁ　 c ".encode())
    assert norm.decode() == "▁XAfi▁c"
    text = "  abaﬁ　 c ".encode()
    spans = [text[align[i] : align[j]] for i, j in ((3, 4), (4, 5), (5, 7), (10, 11))]
    assert spans == [b"ab", b"a", "ﬁ".encode(), b"c"]


def test_fertility_base(spark):
    texts = corpus(8) + ["a b c " * 40, "# x\n# x\n\n# x\n" + " ".join(map(str, range(60)))]
    rows = {r.doc_id: r for r in fertility.judge(frame(spark, texts), *VOCABULARIES).collect()}
    for d, t in enumerate(texts):
        w, r = split(t), rows[d]
        grams: dict = {}
        for i in range(len(w) - 2):
            grams.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += bool(split(line)) and line in seen
            seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert fertility.judge(frame(spark, []), *VOCABULARIES).count() == 0


def accuracy(rows, labels, name):
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50, name
    return sum(p == y for p, y in held) / len(held)


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, larger):
    labels = {r.doc_id: r.quality for r in queries.table(spark, larger, "labels").collect()}
    rows = queries.op6_quality(spark, larger).collect()
    assert accuracy(rows, labels, "quality") > 0.9
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.7) for r in rows)


def test_toxicity_held_out(spark, larger):
    labels = {r.doc_id: r.toxic for r in queries.table(spark, larger, "labels").collect()}
    rows = queries.op8_toxicity(spark, larger).collect()
    assert accuracy(rows, labels, "toxic") > 0.92
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_held_out(spark, larger):
    langs = {r.doc_id: r.lang for r in queries.table(spark, larger, "documents").collect()}
    held = [(r.lang_pred, langs[r.doc_id]) for r in queries.op9_languages(spark, larger).collect() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_languages_beyond_one_slice_and_signs(spark):
    """More languages than bits of an integer are all learned; signs are no letters."""
    rng = random.Random(5)
    rows = []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        # The last languages are the rarest.
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(30)), f"l{k:02}") for i in range(12 if k < 64 else 9)]
    signs = ["— – “” …", "€ ° £", "😀👍", "。、「」", "42 17", ""]
    rows += [(10_000 + i, t, None) for i, t in enumerate(signs)] + [(10_100, "日本語", None)]
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [(i, lang) for i, _, lang in rows if lang and got[i].lang_pred != lang] == []
    assert all(got[10_000 + i].lang_pred == "und" and got[10_000 + i].score == 0 for i in range(len(signs)))
    assert got[10_100].lang_pred != "und"


@pytest.mark.parametrize("op", ["quality", "toxicity", "languages"])
def test_learners_on_odd_rows(spark, op):
    docs, empty = frame(spark, ODD + ["42 17"]), frame(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    few = spark.createDataFrame([(i, i % 2, i % 2, "clash") for i in range(len(ODD))] + [(0, 0, 0, "twice"), (99, 1, 1, "absent"), (None, 1, 1, "null")], "doc_id long, quality int, toxic int, text string")
    for d, n in ((docs, len(ODD) + 1), (empty, 0)):
        for lab in (none, few):
            rows = (languages.identify(d) if op == "languages" else {"quality": quality, "toxicity": toxicity}[op].score(d, lab)).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
            if op == "languages":
                assert all(r.lang_pred == "und" and r.score == 0 for r in rows if ([*ODD, "42 17"][r.doc_id] or "").strip() in ("", "42 17"))


def test_clauses():
    words = toxicity.lexicon({})
    texts = ["You idiot!", "She is not an idiot.", "He said you idiot", "I will kill you", "an idiot; a moron", "nice words you said", "No way. idiot", ""]
    got = toxicity.patterns(pa.RecordBatch.from_pydict({"text": texts}), words)
    named = [{p: int(n) for p, n in zip(toxicity.PATTERNS, row, strict=True) if n} for row in got]
    assert named == [{"targeted_insult": 1}, {"negated": 1}, {"reported": 1}, {"targeted_threat": 1}, {"insult": 2}, {}, {"insult": 1}, {}]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One<br>two <b>thr</b>ee<p>x &lt; y &copy;
<div class="share">Share</div><ul><li>a<li>b</ul><section id="comments"><p>bad</p></section></article><aside>Side</aside><form><p>f</p></form><footer>Foot</footer></body></html>"""


def test_page_text():
    assert webtext.read(PAGE)[0] == ["Title & more", "One", "two three", "x < y ©", "a", "b"]
    for odd in ("", "<", "<p", "<p>&am", "text only", "<div><p>a</div>b", "<!-- x", "<script>never ends", "<table><tr><td>1<td>2</table>"):
        webtext.read(odd)
    assert webtext.read("<p>&amp;&am")[0] == ["&&am"]


def test_templates_go_by_host(spark):
    body = '<div><div class="x1">Our great site since 1999</div><p>Text number {} stands here alone.</p></div>'
    rows = [(i, f"http://h{i % 2}.org/p{i}", f"<html><body>{body.format(i)}</body></html>" if i % 2 == 0 else f"<html><body><div>Other {i}</div><p>Odd {i}</p></body></html>", "clash") for i in range(24)]
    rows += [(100, None, None, ""), (101, "not a url", "", ""), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, webtext.extract(pages).collect()), key=str)
    assert got == sorted(map(tuple, webtext.extract(pages, max_broadcast=0).collect()), key=str)
    texts = {g[0]: g[2] for g in got}
    assert texts[2] == "Text number 2 stands here alone." and texts[1] == "Other 1 Odd 1" and texts[100] == ""
    assert len(got) == len(rows) and all(g[3] == len(g[2]) for g in got)
    assert webtext.extract(pages.limit(0)).count() == 0


def test_article_content_stays():
    for name in ("legal-analysis", "search-history", "related-work", "social-science", "page-header", "commentary", "advertising-ethics"):
        assert webtext.read(f'<article><div class="{name}"><p>Body text here.</p></div><p>end</p></article>')[0] == ["Body text here.", "end"], name
    for name in ("ad", "ad-box", "cookie-notice", "related-posts", "comment-list", "shareButtons", "x newsletter", "sidebar_left"):
        assert webtext.read(f'<article><div class="{name}"><p>Other.</p></div><p>end</p></article>')[0] == ["end"], name
    assert webtext.read("<article><p>see <label>the label</label> and <math><mi>x</mi></math></p></article>")[0] == ["see the label and x"]
    assert webtext.read('<div class="site-header">H</div><p>t</p>')[0] == ["t"]


def test_main_text_by_share():
    long = "Many words of the main text. " * 8
    read = lambda page: " ".join(webtext.read(page)[0])
    assert read('<div id="content"><p>Long main text one.</p><p>two</p></div><article class="card"><p>teaser</p></article>') == "Long main text one. two"
    cards = "".join(f'<article class="card"><h2>Card {k}</h2><p>Some words.</p></article>' for k in range(5))
    assert read(cards + "<p>more</p>") == " ".join(f"Card {k} Some words." for k in range(5))
    answers = f'<article class="comment"><p>{long * 3}</p></article><article><p>Short answer.</p></article><article id="reply-form"><p>{long}</p></article>'
    assert read(f"<article><h1>T</h1><p>{long}</p></article>{answers}<p>outside</p>") == "T " + long.strip()
    assert read(f"<article><p>{long}</p></article><article><p>{long} second part</p></article>") == f"{long.strip()} {long.strip()} second part"
    assert read(f"<main><p>{long}</p><article><p>teaser</p></article></main><p>out</p>") == long.strip()
    assert read("<main></main><p>all there is</p>") == "all there is" and read("<article></article><p>all</p>") == "all"
    assert read(f'<article><p>{long}</p><p role="note">A remark.</p><p role="status">Done.</p><p role="alert">No.</p></article><div role="note">n</div>') == long.strip() + " A remark. Done."
    assert read(f"<article><p>{long}</p><article><p>inner</p></article></article>") == long.strip() + " inner"


def test_long_pages_and_clashing_names(spark):
    body = " ".join(f"word{k}" for k in range(200_000))
    page = f"<html><body><nav>Menu</nav><article><p>{body}</p>" + "<p>x&amp;y</p>" * 20_000 + "</article></body></html>"
    schema = "page_id int, url string, html string, host string, template string, salt int, text string, n_chars string, subtree long, content long"
    pages = spark.createDataFrame([(1, "http://a.b/", page, *("x", "y", 1, "t", "n", 2, 3)), (None, None, "<p>t</p>", *[None] * 7)], schema)
    for most in (400_000, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in webtext.extract(pages, max_broadcast=most).collect()}
        want = f"{body} " + " ".join(["x&y"] * 20_000)
        assert got == {1: (want, len(want)), None: ("t", 1)}


def test_deep_markup_takes_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        assert webtext.read("<div>" * n + "x" + "</p></li>" * n)[0] == ["x"]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def plain_pages(rows):
    """Texts of pages by a tree of nested lists, hashes of whole subtrees as text, and counts in dictionaries."""
    from collections import defaultdict
    from html.parser import HTMLParser

    void = "br hr img meta link input".split()
    block = "article aside body div footer form h1 h2 head html li nav p table td tr ul section header main".split()
    drop = "nav footer aside form script style head title".split()

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.root = ["", {}, [], None]
            self.open = [self.root]

        def handle_starttag(self, tag, attrs):
            if tag in block:
                while any(e[0] == "p" for e in self.open):
                    self.open.pop()
                if tag in ("li", "td", "tr"):
                    shuts = {"li": ["li"], "td": ["td"], "tr": ["tr", "td"]}[tag]
                    while self.open[-1][0] in shuts or (self.open[-1][0] not in ("ul", "table", "div", "article", "body", "html", "") and any(e[0] in shuts for e in self.open)):
                        self.open.pop()
            e = [tag, dict(attrs), [], None]
            self.open[-1][2].append(e)
            if tag not in void:
                self.open.append(e)

        def handle_endtag(self, tag):
            if any(e[0] == tag for e in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            self.open[-1][2].append(data)

    def tree(page):
        t = Tree()
        t.feed(page or "")
        t.close()
        return t.root

    def key(e):
        if e[0] in ("script", "style", "title"):
            return None
        parts = [k for k in (x if isinstance(x, str) and x.strip() else None if isinstance(x, str) else key(x) for x in e[2]) if k]
        e[3] = f"<{e[0]}>" + "|".join(parts) if parts else None
        return e[3]

    def walk(e, inside=False):
        inside = inside or e[0] in ("article", "main")
        yield e, inside
        for x in e[2]:
            if not isinstance(x, str):
                yield from walk(x, inside)

    def lines(e, gone, inside=False):
        if e[0] in drop or e[1].get("class") == "ad" or e[3] in gone:
            return
        inside = inside or e[0] in ("article", "main")
        if e[0] in block or e[0] in void:
            yield None, inside
        for x in e[2]:
            if isinstance(x, str):
                yield x, inside
            else:
                yield from lines(x, gone, inside)
        if e[0] in block:
            yield None, inside

    def text(root, gone):
        found, now, has = [], [], any(e[0] in ("article", "main") for e, _ in walk(root))
        for x, inside in [*lines(root, gone), (None, False)]:
            if x is None:
                joined = " ".join("".join(y for y, _ in now).split())
                if joined:
                    found.append((joined, now[-1][1]))
                now = []
            else:
                now.append((x, inside))
        if has and any(i for _, i in found):
            found = [f for f in found if f[1]]
        return [t for t, _ in found]

    kept = ["p", "h1", "h2", "li", "td", "tr"]
    pages, seen = {}, defaultdict(lambda: defaultdict(set))
    host = lambda u: re.sub(r"^[a-z]+://([^/?#:]*).*$", r"\1", u or "").lower() if "://" in (u or "") else ""
    for i, url, page in rows:
        root = tree(page)
        key(root)
        pages[i] = root
        content = "\n".join(text(root, set()))
        seen[host(url)][None].add(content)
        for e, inside in walk(root):
            if e[3] and not (inside and e[0] in kept) and e[0] not in ("", "html", "body", "article", "main", "b", "i", "a", "em", "strong", "span", "code"):
                seen[host(url)][e[3]].add(content)
    gone = {h: {k for k, c in by.items() if k and len(c) >= 4 and len(c) >= 0.2 * len(by[None])} for h, by in seen.items()}
    return {i: " ".join(text(pages[i], gone[host(url)])) for i, url, _ in rows}


def test_page_texts_against_a_plain_reading(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in queries.table(spark, small, "pages").collect()]
    want = plain_pages(rows)
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op1_webtext(spark, small).collect()}
    assert {i for i in want if got[i][0] != want[i]} == set()
    assert all(n == len(t) for t, n in got.values()) and sum(bool(t) for t, _ in got.values()) > 0.8 * len(got)


def test_fertility_measures_and_verdicts_against_plain_python(spark, small):
    """Measures by the libraries' own calls, bands and verdicts from them in plain Python, over all documents."""
    import base64
    import math
    from collections import Counter, defaultdict

    import tiktoken

    with open(queries.RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte_code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    docs = {r.doc_id: r for r in queries.table(spark, small, "documents").collect()}
    rows = {r.doc_id: r for r in fertility.judge(queries.table(spark, small, "documents"), *VOCABULARIES, least=30).collect()}
    assert set(rows) == set(docs)
    measures, groups = {}, defaultdict(dict)
    for i, r in rows.items():
        t = docs[i].text or ""
        ids = sp.encode(t)
        p = [n / len(ids) for n in Counter(ids).values()]
        words = split(t)
        cut = sum(len(byte_code.encode_ordinary(" " + w)) for w in words)
        want = (len(t) / max(1, len(ids)), sum(map(sp.is_byte, ids)) / max(1, len(ids)), -sum(x * math.log2(x) for x in p), sum(map(len, words)) / max(1, cut))
        assert (r.chars_per_token, r.byte_share, r.entropy, r.word_chars_per_token) == pytest.approx(want)
        measures[i] = dict(zip(("chars_per_token", "byte_share", "entropy", "word_chars_per_token"), want, strict=True))
        if not r.base_failed:
            for g in (f"lang:{docs[i].lang}", f"script:{r.script}", "all"):
                groups[g][t] = i
    sizes = {g: len(x) for g, x in groups.items()}
    read = lambda values: [sorted(values)[max(0, math.ceil(k / 40 * len(values)) - 1)] for k in range(41)]
    band = {}
    for g, texts in groups.items():
        by = defaultdict(list)
        for i in texts.values():
            by[round(2 * math.log2(rows[i].n_tokens + 1))].append(i)
        frame_of = [(len(x), sum(math.log2(rows[i].n_tokens + 1) for i in x) / len(x), fertility.shortest_half(read([measures[i]["entropy"] for i in x]))[0]) for x in by.values()]
        import pandas as pd

        c = fertility._curve(pd.DataFrame({"fertility_group": g, "n": [f[0] for f in frame_of], "x": [f[1] for f in frame_of], "y": [f[2] for f in frame_of]})).iloc[0]
        for i in texts.values():
            measures[i][g] = None
        gap = lambda i, c=c: measures[i]["entropy"] - (c.c0 + c.c1 * math.log2(rows[i].n_tokens + 1) + c.c2 * math.log2(rows[i].n_tokens + 1) ** 2)
        band[g] = gap, {m: fertility.shortest_half(read([gap(i) if m == "entropy_gap" else measures[i][m] for i in texts.values()])) for m in fertility.BANDS}
    wrong = []
    for i, r in rows.items():
        g = next(x for x in (f"lang:{docs[i].lang}", f"script:{r.script}", "all") if x == "all" or sizes.get(x, 0) >= 30)
        assert r.fertility_group == g
        bad = r.base_failed
        for m, (low, high, floor) in fertility.BANDS.items():
            mid, half = band[g][1][m]
            v = band[g][0](i) if m == "entropy_gap" else measures[i][m]
            room = 1 if m == "entropy_gap" else max(1, 1000 / max(1, r.n_tokens)) ** 0.5
            bad |= v < mid - room * low * max(half, floor) or v > mid + room * high * max(half, floor)
        wrong += [i] if r.kept == bad else []
    assert wrong == [] and 0.2 < sum(r.kept for r in rows.values()) / len(rows) < 0.95


def test_fertility_bands_withstand_junk_and_copies(spark):
    """A third of junk, and a text that is copied more often than all others together, do not move the bands."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 300))) for _ in range(160)]
    junk = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) + " " for _ in range(rng.randint(60, 300))) for _ in range(80)]
    copies = [" ".join(["same", "words"] + [f"{k}" for k in range(70)])] * 400
    rows = {r.doc_id: r for r in fertility.judge(frame(spark, good + junk + copies).withColumn("lang", F.lit("xx")), *VOCABULARIES).collect()}
    assert sum(rows[i].kept for i in range(160)) > 150 and not any(rows[160 + i].kept for i in range(80))


def test_clause_counts_against_a_plain_reading(spark, small):
    """Counts of clauses under the fixed lists, word by word in plain Python, over all documents and some sentences."""
    kind = {w: k for k, words in toxicity.LISTS.items() for w in words.split()}
    low = lambda t: re.sub("[A-ZÀ-Þ]", lambda m: m[0].lower() if m[0] != "×" else m[0], t)

    def counts(text):
        out = dict.fromkeys(toxicity.PATTERNS, 0)
        for part in re.split(r"[.!?;:\n]", low(text)):
            left, reported, target, held = 0, False, False, None
            rank = [None, "negated", "reported", "threat", "slur", "insult"]
            for w in re.findall(r"[A-Za-z'\u0080-\U0010ffff]+", part):
                k = kind.get(w, toxicity.OTHER)
                if k == toxicity.TARGET:
                    target = True
                if k in (toxicity.INSULT, toxicity.THREAT):
                    new = "reported" if reported else "negated" if left else "insult" if k == toxicity.INSULT else "threat"
                    held = max(held, new, key=rank.index)
                reported |= k == toxicity.REPORT
                left = 3 if k == toxicity.NEGATION else max(0, left - 1)
            if held:
                out[f"targeted_{held}" if target and held in ("insult", "threat") else held] += 1
        return [out[p] for p in toxicity.PATTERNS]

    rng = random.Random(3)
    some = [w for words in toxicity.LISTS.values() for w in words.split()] + ["word", "Über", "É"] * 20
    texts = [" ".join(rng.choice(some) + rng.choice(["", "", "", ".", ",", "!", "\n", ";"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [r.text or "" for r in queries.table(spark, small, "documents").select("text").collect()]
    got = toxicity.patterns(pa.RecordBatch.from_pydict({"text": texts}), toxicity.lexicon({}))
    assert got.astype(int).tolist() == [counts(t) for t in texts]


def test_rarer_insults_are_learned_from_more_labels(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(300)]
    rare = ["zwxqvor" + e for e in ("", "s", "ly")]
    texts, labels = [], []
    for i in range(3000):
        bad = i % 3 == 0
        w = [rng.choice(common) for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = rng.choice(rare) if i % 30 == 0 else "gnarvik"
        texts.append((i, " ".join(w), "x", 0.1))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(texts, "doc_id long, text string, threat string, score double")
    rows = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, labels[r.doc_id][1], r.doc_id) for r in rows if r.held_out]
    assert sum(p == y for p, y, _ in held) / len(held) > 0.97
    assert sum(p for p, _, i in held if i % 30 == 0) > 0.8 * sum(1 for _, _, i in held if i % 30 == 0)
    kept = toxicity.clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_pieces_of_a_model_with_a_character_map(spark, tmp_path):
    """A model with a map, squeezed white space and byte fallback gives the ids of the library, and spans of the source."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(queries.PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = charsmap({"ﬁ".encode(): b"fi", "ﬂ".encode(): b"fl", "Ａ".encode(): b"A", "　".encode(): b" ", "…".encode(): b"..."})
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["  ﬁne  ﬂow　Ａ… ", "plain text", "", "   ", "ﬁ", "日本 ﬁ 日本", None]
    for r in pieces.encode(frame(spark, texts), str(path)).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == sp.encode(t) and r.decoded == sp.decode(r.ids)
        raw = t.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(r.begins, r.ends, strict=True)) and r.begins == sorted(r.begins)
        raw.decode() and [raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)]


def test_pieces_same_as_the_library_on_all_documents(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()}
    rows = queries.op2_pieces(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_word_vectors_against_plain_python(spark):
    """Vocabulary, sums of index vectors around each place, and means of documents, run by run."""
    from collections import Counter

    texts = [t for t in corpus(11, 60)] + ["Aaa!!! aaa AAA 12 12 #tag, no", "WORD WORD word"]
    rows = frame(spark, texts).select("doc_id", "text")
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    hash_of = lambda s: tp.hash_ranges(np.frombuffer(low(s).encode(), np.uint8), np.array([0]), np.array([len(s.encode())]))[0]

    def cut(t):
        """Runs with their fixed places."""
        out, before = [], None
        raw = (t or "").encode()
        for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^A-Za-z0-9\x80-\xff \t-\r])\1*", raw):
            s = m[0]
            letters, digits = bool(re.match(rb"[A-Za-z\x80-\xff]", s)), s[:1].isdigit()
            h = tp.hash_ranges(np.frombuffer(re.sub(rb"[A-Z]", lambda x: x[0].lower(), s), np.uint8), np.array([0]), np.array([len(s)]))[0]
            at = -1
            if letters and len(s) > 1 and 2 * len(re.findall(rb"[A-Z]", s)) > len(s):
                at = min(len(s), quality.CAPITALS - 1)
            if not letters and not digits:
                at = quality.CAPITALS + max(3, s[0])
            if h == before:
                at = quality.CAPITALS + quality.SIGNS + (0 if letters else 1 if digits else 2)
            before = h
            out.append((int(h), at))
        return out

    assert int(hash_of("Abc")) == int(hash_of("abc"))
    documents = [cut(t) for t in texts]
    n = Counter(h for d in documents for h, at in d if at < 0)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    words = sorted(sorted((h for h in n if n[h] >= 5), key=lambda h: (-n[h], signed(h)))[:40])
    got = quality.vocabulary(rows, floor=5, most=40)
    assert got.tolist() == words
    place = lambda h, at: at if at >= 0 else quality.FIXED + quality.SHARED + words.index(h) if h in words else quality.FIXED + h % quality.SHARED
    index, signs = quality.index_vectors(got)
    total = np.zeros((quality.FIXED + quality.SHARED + len(words), quality.DIM))
    for d in documents:
        p = [place(*x) for x in d]
        for i, x in enumerate(p):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(p):
                    for k in range(2):
                        total[x, index[p[j], k]] += signs[p[j], k]
    total = np.sign(total) * np.sqrt(np.abs(total))
    total -= total.mean(axis=0)
    total /= np.maximum(np.linalg.norm(total, axis=1), 1e-9)[:, None]
    vectors = quality.word_vectors(rows, spark.sparkContext.broadcast(got))
    assert np.allclose(vectors, total, atol=1e-5)
    means = quality.pool(pa.RecordBatch.from_pydict({"text": texts}), vectors, got)
    for d, m in zip(documents, means, strict=True):
        want = np.mean([total[place(*x)] for x in d], axis=0) if d else np.zeros(quality.DIM)
        assert np.allclose(m[:-1], want, atol=1e-5) and m[-1] == pytest.approx(np.log1p(len(d)) / 10)


def test_suffix_ranks():
    rng = np.random.default_rng(5)
    for n, kinds, width in ((0, 3, 13), (1, 3, 13), (200, 2, 13), (300, 3, 5), (120, 2, 1), (90, 4, 8)):
        words = rng.integers(0, kinds, n)
        got = repeats.suffix_ranks(words, width)
        seen = [tuple(words[i : i + width]) for i in range(n)]
        order = {s: k for k, s in enumerate(sorted(set(seen)))}
        assert got.tolist() == [order[s] for s in seen]


CLASH = "score predicted lost row hi lo tokens gid n key kept component_id pii_types letter held_out y may content fertility_group reasons hit_spans item_ids n_words insult band own shared rep copies".split()


def operators(spark, docs):
    """Every operator on documents, as it is used with production parameters."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("i", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id string, text string")
    return {
        "pieces": lambda: pieces.encode(docs, queries.PIECES), "privacy": lambda: privacy.pseudonymise(docs, "k"), "jaccard": lambda: jaccard.join(docs), "repeats": lambda: repeats.remove(docs), "quality": lambda: quality.score(docs, labels),
        "fertility": lambda: fertility.judge(docs, *VOCABULARIES), "toxicity": lambda: toxicity.score(docs, labels), "toxicity_clean": lambda: toxicity.clean(docs, labels), "languages": lambda: languages.identify(docs), "decontaminate": lambda: decontaminate.decontaminate(docs, items),
    }


@pytest.mark.parametrize("name", "pieces privacy jaccard repeats quality fertility toxicity toxicity_clean languages decontaminate".split())
def test_long_texts_clashing_names_and_empty_tables(spark, name):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(1_600_000))
    assert len(long) > 8_000_000
    odd = "x@" + "a." * 50_000 + " password=" + "s3" * 10_000 + " " + "/a" * 1000
    rows = [(0, long, "en"), (1, long, "en"), (2, odd, None), (3, None, "de"), (4, "", "en"), (4, "", "en"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 no id", "en"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit(1).alias(c) for c in CLASH))
    got = operators(spark, docs)[name]().collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got if r.doc_id is not None) == [0, 1, 2, 3, 4, 4, 5]
    by = {r.doc_id: r for r in got}
    if name == "jaccard":
        assert by[1].component_id == 0 and by[1].n_links == by[0].n_links == 1 and by[0].n_shingles > 1_500_000 and by[None].component_id is None
    if name == "repeats":
        assert by[0].n_removed == 0 and by[1].n_removed == by[1].n_words == 1_600_000
    if name == "pieces":
        assert by[0].decoded == long and by[0].ends[-1] == len(long)
    if name == "privacy":
        assert by[0].text == long and "s3s3" not in by[2].text and len(by[2].text) == len(odd) and by[3].text is None
    if name == "decontaminate":
        assert by[5].item_ids == by[None].item_ids == ["i"]
    if name == "fertility":
        assert by[0].n_words == 1_600_000
    assert operators(spark, docs.limit(0))[name]().count() == 0


def test_parted_by_filter_and_by_join(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(500)] + [(None, "x")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(3,), (3,), (None,)], "id long")
    want = {*range(0, 500, 7), 3}
    for limit in (1 << 20, 0):
        rows = exchange.parted(docs, ids, limit)
        among, others = [r.doc_id for r in rows(True).collect()], [r.doc_id for r in rows(False).collect()]
        assert want <= set(among) and None in others and sorted(map(str, among + others)) == sorted(str(r.doc_id) for r in docs.collect())
        assert limit or set(among) == want


def test_languages_against_plain_python(spark, small):
    """Filters, shares and decisions, n-gram by n-gram in plain Python, over all documents."""
    from collections import Counter, defaultdict
    from zlib import crc32

    docs = queries.table(spark, small, "documents").collect()
    letter = lambda b: 97 <= b <= 122 or 65 <= b <= 90 or (b >= 128 and b != 0xC2)

    def grams(text):
        raw, out, before = (text or "").encode(), [], 0
        for b in raw:
            x = 0 if not letter(b) else b + 32 if 65 <= b <= 90 or (before == 0xC3 and 0x80 <= b <= 0x9E) else b
            before = b
            if x or not out or out[-1]:
                out.append(x)
        return {n: [int.from_bytes(bytes(out[i : i + n]), "little") | n << 56 for i in range(len(out) - n + 1)] for n in languages.LENGTHS}

    held = lambda i: crc32(str(i).encode()) % 3 == 1
    of = {r.doc_id: grams(r.text) for r in docs}
    langs = sorted({r.lang for r in docs if r.lang and not held(r.doc_id)})
    filters, false = {}, {}
    for x in langs:
        own = np.zeros(languages.BITS, bool)
        for n in languages.LENGTHS:
            c = Counter(g for r in docs if r.lang == x and r.text is not None and not held(r.doc_id) for g in of[r.doc_id][n])
            some = np.array([g for g, k in c.items() if k >= max(2.0, sum(c.values()) / 40_000)], np.uint64)
            for p in languages._places(tp.mix(some)):
                own[p] = True
        filters[x], false[x] = own, own.mean() ** 2
    got = {r.doc_id: r for r in queries.op9_languages(spark, small).collect()}
    for r in docs:
        all_of = np.array([g for n in languages.LENGTHS for g in of[r.doc_id][n]], np.uint64)
        share = defaultdict(float)
        if len(all_of):
            a, b = languages._places(tp.mix(all_of))
            share.update({x: min(1, max(0, ((filters[x][a] & filters[x][b]).mean() - false[x]) / (1 - false[x]))) for x in langs})
        top = sorted(langs, key=lambda x: -share[x])
        want = top[0] if re.search(r"[^\W\d_]", r.text or "") else "und"
        assert got[r.doc_id].lang_pred == want and got[r.doc_id].held_out == held(r.doc_id)
        if want != "und" and share[top[0]] > 0:
            assert got[r.doc_id].score == pytest.approx(share[top[0]] / (share[top[0]] + share[top[1]]))
