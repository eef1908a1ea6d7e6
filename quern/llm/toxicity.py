"""Toxicity from a weighted finite-state grammar over clauses.

Words are classed as insult, slur, threat, target, negation, reported speech or other. Two
transducers are composed into one machine that reads a clause: the first rewrites classes
by scope (an insult or threat shortly after a negation is negated, one after a word of
reported speech is reported), the second collects what was rewritten and names, at the
clause's end, the pattern that the clause matches. Isolated words are not scored; clauses
are, by the weight of their pattern, and a text by the sum over its clauses.

The fixed word lists below seed the classes. Insults are also learned: as beginnings of
words that stand in several different contexts in toxic documents, and whose rate there is above that in others by a
factor that a lower bound on it (so many standard errors below the estimate) still keeps; a beginning that a lower factor
bounds is a slur. More labels so admit rarer words. Which factors are asked for is chosen, and weights of patterns are
learned by logistic regression, on one half of the labelled rows with the beginnings learned from the other half.

Labels are read from a bounded sample: about ``per_label`` rows of each label, outside the
held-out fold. Their texts are read once and kept; scoring reads whole texts of all documents, once. Null and empty texts have no
clause and get the base score. Without labels to learn from, the fixed lists and
``DEFAULT_WEIGHTS`` stand. Repeated rows are scored alike; extra columns are ignored, whatever their names; an empty table
gives no rows; very long texts are read whole. Of factors whose loss is within a standard error of the least, the largest are taken; of several labels of a document the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import folds
from quern.llm import textpack as tp
from quern.llm.store import materialise

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SLUR, END = range(8)

# Seed words of each class in English, German, French and Spanish.
LISTS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting dumb imbecile cretin dummkopf abschaum arschloch connard salaud imbécile crétin basura imbécil estúpido inútil",
    THREAT: "kill hurt destroy beat shoot stab burn die töten umbringen verletzen schlagen sterben tuer frapper détruire mourir matar golpear destruir morir",
    TARGET: "you your yours yourself he she they them him her these those people du dich dir dein ihr euch sie er tu te toi vous votre il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas",
    NEGATION: "not no never neither nor without isn't aren't don't doesn't nicht kein keine keinen nie niemals ohne ne pas jamais ni sans nunca jamás sin tampoco",
    REPORT: "said says wrote writes called calls quoted reported claimed alleged according sagte sagt schrieb nannte behauptete laut dit écrit appelé affirmé selon dijo escribió llamó afirmó según",
}
PATTERNS = ("insult", "targeted_insult", "slur", "targeted_slur", "threat", "targeted_threat", "negated", "reported")
DEFAULT_WEIGHTS = {"base": -4.0, "insult": 3.0, "targeted_insult": 4.0, "slur": 1.0, "targeted_slur": 1.5, "threat": 1.0, "targeted_threat": 3.5, "negated": 0.5, "reported": 0.5}
#: Words after a negation that it still covers.
SCOPE = 3
#: Lower bounds on the logarithms of the factors that make a beginning an insult, or a slur; the labelled rows choose among them.
FACTORS = ((5.0, 2.5), (4.5, 2.0), (4.0, 2.0), (3.5, 1.5), (3.0, 1.5), (3.0, 1.0), (2.5, 1.0), (2.0, 1.0), (1.5, 0.75), (1.0, 0.5))
#: Standard errors below the estimate where the bound lies, and different words before a beginning that are needed.
ERRORS, CONTEXTS = 2.0, 4
#: Lengths in bytes of the beginnings of words that are tried; 0 is the whole word.
PREFIXES = (4, 5, 6, 7, 8)

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = _LETTERS[39] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?;:\n")] = True


def scope() -> dict:
    """Rewrites classes: (state, class) -> (state, symbol). States: 0, 1..SCOPE words of negation left, 'r' reported."""
    rules: dict = {}
    for s in [*range(SCOPE + 1), "r"]:
        left = s if s == "r" else max(0, s - 1)
        rules[s, OTHER] = (left, None)
        rules[s, TARGET] = (left, "target")
        rules[s, NEGATION] = (s if s == "r" else SCOPE, None)
        rules[s, REPORT] = ("r", None)
        rules[s, END] = (0, "end")
        for c, name in ((INSULT, "insult"), (SLUR, "slur"), (THREAT, "threat")):
            rules[s, c] = (left, "reported" if s == "r" else "negated" if s else name)
    return rules


def clause() -> dict:
    """Collects symbols: (state, symbol) -> (state, pattern). A state is (seen a target, strongest symbol)."""
    rank = {None: 0, "negated": 1, "reported": 2, "threat": 3, "slur": 4, "insult": 5}
    rules: dict = {}
    for target in (False, True):
        for held in rank:
            rules[(target, held), None] = ((target, held), None)
            rules[(target, held), "target"] = ((True, held), None)
            for new in list(rank)[1:]:
                rules[(target, held), new] = ((target, max(held, new, key=lambda x: rank[x])), None)
            name = f"targeted_{held}" if target and held in ("insult", "slur", "threat") else held
            rules[(target, held), "end"] = ((False, None), name)
    return rules


def compose(first: dict, second: dict, start: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The machine that runs both at once: tables of next states and of patterns put out (-1: none)."""
    states, todo = {start: 0}, [start]
    moves: dict[tuple[int, int], tuple[int, int]] = {}
    while todo:
        s = todo.pop()
        for c in range(END + 1):
            a, symbol = first[s[0], c]
            b, out = second[s[1], symbol]
            if (a, b) not in states:
                states[a, b] = len(states)
                todo.append((a, b))
            moves[states[s], c] = states[a, b], PATTERNS.index(out) if out else -1
    after = np.array([[moves[i, c][0] for c in range(END + 1)] for i in range(len(states))])
    put = np.array([[moves[i, c][1] for c in range(END + 1)] for i in range(len(states))])
    return after, put


MACHINE = compose(scope(), clause(), (0, (False, None)))


def _words(part: pa.RecordBatch) -> tuple[tp.Words, dict[int, np.ndarray]]:
    """Words in lower case (ASCII and Latin-1), with hashes of their beginnings; 0 is the whole word."""
    buf, off = tp.buffers(part["text"])
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    up = ((buf >= 65) & (buf <= 90)) | (after & (buf >= 0x80) & (buf <= 0x9E))
    w = tp.split_buffer(buf + (up.astype(np.uint8) << 5), off, _LETTERS)
    whole, some = tp.hash_ranges(w.buf, w.start, w.end, PREFIXES)
    w._hash = whole
    return w, some | {0: whole}


def lexicon(learned: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and their classes by length of beginning; the lists, and what was learned."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in (0, *PREFIXES):
        h, c = [learned[n][0]] if n in learned else [np.zeros(0, np.uint64)], [learned[n][1]] if n in learned else [np.zeros(0, np.int64)]
        if n == 0:
            for kind, words in LISTS.items():
                raw = [x.encode() for x in words.split()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                h.append(tp.hash_ranges(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]))
                c.append(np.full(len(raw), kind))
        hashes, classes = np.concatenate(h), np.concatenate(c)
        unique, at = np.unique(hashes[::-1], return_index=True)  # a fixed list wins over a learned insult
        out[n] = unique, classes[::-1][at]
    return out


def classify(w: tp.Words, begins: dict[int, np.ndarray], lexicon: dict) -> np.ndarray:
    kind = np.zeros(len(w.start), np.int64)
    for n in (*PREFIXES, 0):
        hashes, classes = lexicon[n]
        if len(hashes):
            i = np.minimum(np.searchsorted(hashes, begins[n]), len(hashes) - 1)
            hit = np.flatnonzero(hashes[i] == begins[n])
            new = classes[i[hit]]
            kind[hit] = np.where((kind[hit] == INSULT) & (new == SLUR), INSULT, new)
    return kind


def patterns(part: pa.RecordBatch, lexicon: dict) -> np.ndarray:
    """How many clauses of each text match each pattern."""
    w, begins = _words(part)
    kind = classify(w, begins, lexicon)
    out = np.zeros((part.num_rows, len(PATTERNS)))
    strong = np.flatnonzero((kind == INSULT) | (kind == SLUR) | (kind == THREAT))
    if not len(strong):
        return out
    stops = np.concatenate([[0], np.cumsum(_STOPS[w.buf])])
    number = stops[w.start] + w.doc  # grows at each stop, and from text to text
    left = np.searchsorted(number, number[strong], side="left")
    right = np.searchsorted(number, number[strong], side="right")
    after, put = MACHINE
    done = -1
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if a == done:
            continue
        done, state = a, 0
        for c in kind[a:b].tolist():
            state = after[state, c]
        if (p := put[state, END]) >= 0:
            out[w.doc[a], p] += 1
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each beginning of a word with the word before it, once for each batch."""
    for batch in batches:
        for part in tp.slices(batch, "text"):
            w, begins = _words(part)
            before = np.concatenate([np.zeros(1, np.uint64), w.hash[:-1]]) if len(w.hash) else w.hash
            for n, h in begins.items():
                long_enough = h != 0
                pair, at = np.unique(tp.mix(h + before * np.uint64(0xD6E8FEB86659FD93))[long_enough], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), n)), pa.array(h[long_enough][at].view(np.int64)), pa.array(pair.view(np.int64))], ["n", "begin", "pair"])


def _occurs(tried: dict[int, np.ndarray]):
    """In how many documents of each label each of the tried beginnings occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                w, begins = _words(part)
                label = part["y"].to_numpy()
                for n, t in tried.items():
                    i = np.minimum(np.searchsorted(t, begins[n]), len(t) - 1)
                    hit = np.flatnonzero(t[i] == begins[n])
                    pair = np.unique(w.doc[hit] * len(t) + i[hit])
                    seen, times = np.unique(label[pair // len(t)] * len(t) + pair % len(t), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array((seen // len(t)).astype(np.int32)), pa.array(np.full(len(seen), n)), pa.array(t[seen % len(t)].view(np.int64)), pa.array(times)], ["y", "n", "begin", "docs"])

    return run


def at_least(hits: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """The logarithm of a factor by which the rate of hits in toxic texts is above that in clean ones at least.

    The one count is taken as low, the other as high, as a Poisson count may be (by the cube root that makes it nearly normal).
    """
    k, c = np.maximum(hits, 1), clean + 1
    low = k * np.maximum(1 - 1 / (9 * k) - ERRORS / (3 * np.sqrt(k)), 0.01) ** 3
    high = c * (1 - 1 / (9 * c) + ERRORS / (3 * np.sqrt(c))) ** 3
    return np.log(low / n_toxic) - np.log(high / n_clean)


def evidence(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes of beginnings by their length, and a lower bound on the logarithm of how much more frequent each is in toxic texts.

    ``sample`` has texts and y; what comes back is bounded by it.
    """
    if not n_toxic or not n_clean:
        return {}
    pairs = sample.where("y = 1").select("text").mapInArrow(tp.task(_contexts), "n bigint, begin bigint, pair bigint").distinct()
    rows = pairs.groupBy("n", "begin").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS).toPandas()
    tried = {int(n): np.sort(x.begin.to_numpy(np.int64).view(np.uint64)) for n, x in rows.groupby("n")}
    if not tried:
        return {}
    # Both labels in one pass.
    seen = sample.select("y", "text").mapInArrow(tp.task(_occurs(tried)), "y int, n bigint, begin bigint, docs bigint").groupBy("n", "begin").agg(*(F.sum(F.when(F.col("y") == y, F.col("docs")).otherwise(0)).alias(name) for y, name in ((1, "toxic"), (0, "clean")))).toPandas()
    rows = rows.merge(seen, on=["n", "begin"], how="left").fillna(0)
    bound = at_least(np.minimum(rows.contexts, rows.toxic).to_numpy(float), rows.clean.to_numpy(float), n_toxic, n_clean)
    out = {}
    for n, x in rows.assign(bound=bound).groupby("n"):
        h = x.begin.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        out[int(n)] = h[order], x.bound.to_numpy()[order]
    return out


def learned(found: dict[int, tuple[np.ndarray, np.ndarray]], factors: tuple[float, float]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Hashes and classes of the beginnings that pass the factors."""
    out = {}
    for n, (h, bound) in found.items():
        some = bound >= factors[1]
        out[n] = h[some], np.where(bound[some] >= factors[0], INSULT, SLUR)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int = 40, penalty: float = 0.05) -> tuple[float, np.ndarray]:
    """Logistic regression of labels on the logarithms of clause counts, by Newton steps; weights are not negative."""
    default = np.array([DEFAULT_WEIGHTS[p] for p in PATTERNS])
    if len(np.unique(y)) < 2:
        return DEFAULT_WEIGHTS["base"], default
    z = np.column_stack([np.ones(len(y)), np.log2(1 + x)])
    start = np.concatenate([[DEFAULT_WEIGHTS["base"]], default])
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * (w - start)
        curve = (z * (p * (1 - p))[:, None]).T @ z + (penalty + 1e-6) * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), w[1:]


def probability(counts: np.ndarray, base: float, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(base + np.log2(1 + counts) @ weights, -30, 30)))


def _counted(lexicons: list[dict]):
    """Counts of clauses under each of some lexicons, one after the other in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tp.slices(batch, "text"):
                found = np.concatenate([patterns(part, x) for x in lexicons], axis=1)
                first = (np.arange(part.num_rows + 1) * found.shape[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["y"], pa.ListArray.from_arrays(pa.array(first), pa.array(found.ravel()))], ["doc_id", "y", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str, fold, per_label: int) -> dict:
    """Lexicon, base and weights; ``docs`` has doc_id and text."""
    rows = folds.sample(folds.labelled(labels, label_col, fold), "y", per_label).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    # Two labels of about per_label rows each are sent to the scan, which keeps the texts of these alone.
    sample = materialise(docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("half").alias("half")))
    n = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    count = lambda y, *halves: sum(n.get((y, h), 0) for h in halves)
    first = evidence(sample.where("half = 0"), count(1, 0), count(0, 0))
    tried = [lexicon(learned(first, f)) for f in FACTORS]
    got = sample.where("half = 1").select("doc_id", "y", "text").mapInArrow(tp.task(_counted(tried)), "doc_id bigint, y int, counts array<double>").orderBy("doc_id").toPandas()
    y, k = got.y.to_numpy(float), len(PATTERNS)
    x = np.array(got.counts.tolist(), float).reshape(len(got), len(FACTORS), k)
    inner = np.arange(len(y)) % 2 == 0
    best = 0
    if len(np.unique(y[inner])) == 2 and not inner.all():
        each = []
        for i in range(len(FACTORS)):
            p = np.clip(probability(x[~inner, i], *fit_weights(x[inner, i], y[inner])), 1e-6, 1 - 1e-6)
            each.append(-(y[~inner] * np.log(p) + (1 - y[~inner]) * np.log(1 - p)))
        loss = np.mean(each, axis=1)
        low = int(np.argmin(loss))
        best = int(np.flatnonzero(loss <= loss[low] + np.std(each[low]) / np.sqrt(len(each[low])))[0])
    base, weights = fit_weights(x[:, best], y)
    return {"lexicon": lexicon(learned(evidence(sample, count(1, 0, 1), count(0, 0, 1)), FACTORS[best])), "base": base, "weights": weights, "factors": FACTORS[best]}


def _model(docs: DataFrame, labels: DataFrame, label_col: str, held_out_mod: int, held_out: int, per_label: int, id_col: str, text_col: str):
    fold = folds.remainder("doc_id", held_out_mod) == held_out
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own, fold, docs.sparkSession.sparkContext.broadcast(train(own, labels, label_col, fold, per_label))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_mod: int = 3, held_out: int = 1, per_label: int = 6000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted and the count of clauses for each pattern."""
    own, fold, model = _model(docs, labels, label_col, held_out_mod, held_out, per_label, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in tp.slices(batch, "text"):
                found = patterns(part, m["lexicon"])
                p = probability(found, m["base"], m["weights"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(pa.array(found[:, k].astype(np.int64)) for k in range(len(PATTERNS)))], ["doc_id", "held_out", "score", "predicted", *PATTERNS])

    return own.select("doc_id", fold.alias("held_out"), "text").mapInArrow(tp.task(run), "doc_id bigint, held_out boolean, score double, predicted int, " + ", ".join(f"{p} bigint" for p in PATTERNS))


def clean(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out_mod: int = 3, held_out: int = 1, per_label: int = 6000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns; they stay where they lie."""
    _, _, model = _model(docs, labels, label_col, held_out_mod, held_out, per_label, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for part in tp.slices(pa.RecordBatch.from_arrays([batch.column(at)], ["text"]), "text"):
                keep.append(probability(patterns(part, m["lexicon"]), m["base"], m["weights"]) < threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(tp.task(run), docs.schema)
