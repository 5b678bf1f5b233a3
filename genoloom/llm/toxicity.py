"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses and a clause into symbols: insult, threat, target (someone addressed or spoken
of), negation, reported speech, or other. Four transducers rewrite the symbols one after the other
(reported speech, negation, target, and the scorer); ``compose`` makes one deterministic machine of them,
so a clause is read once. What it says of a match (plain, aimed at a target, negated, reported; a threat may be followed by its
target) is a weighted arc: the matched word's weight is multiplied by it, and a clause weighs what its matches add up to.
A text has two figures, the weight of its heaviest clause and the logarithm of that of all clauses. Nothing else enters
a score, so a word counts as the grammar reads it.

What is learned comes from labelled rows whose ``crc32(doc_id) mod 4`` is not 2. Word forms and word beginnings get the log odds of
toxic documents, each row's own label being left out when its own figures are made; those above ``LEAST`` are insults. Threats are a
closed class of weight ``THREAT_WEIGHT``, or their log odds if more. A logistic regression makes scores of the figures.
``FIT_ROWS`` bounds the labelled rows that are used (those with the smallest MD5 of the id); a
near copy counts once, by a MinHash of its shingles. The lexicon has every entry that the
fit rows support; their number (``FIT_ROWS``) alone bounds it.

Defined results: null counts as empty; a text without matches, empty ones too, gets the score of the
intercept; a row with a null id is not held out and has no label; of labels that repeat, the largest
holds; with no labelled row of either class every score is the share of toxic rows (0.5 without any);
labels, lang, source and id are no inputs of a score; repeated rows are scored alike; an empty table gives an empty result;
other columns are not read, and those of the rows that stay are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from genoloom.llm import shared

FIT_ROWS, THRESHOLD, FOLDS, HELD_OUT = 20_000, 0.3, 4, 2
#: Prior weight of a count, the log odds from which an entry is an insult, and the weight of a threat.
PRIOR, LEAST, THREAT_WEIGHT = 6.0, 1.8, 4.0
BEGINNINGS = (4, 5, 6)
#: Entries that a worker counts before it sends them, and words of which it keeps the weights.
PENDING, SEEN = 100_000, 200_000

# Closed classes in the languages of the corpus.
TARGETS = frozenset("you your yours u ur he she they them him her his their tu te toi ton ta tes vous votre vos il elle ils elles du dich dir dein deine ihr euch er sie ihn tú ti usted ustedes vosotros él ella ellos ellas su".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't ne pas jamais sans nicht nie kein keine ohne nunca jamás sin".split())
REPORTED = frozenset("said says say wrote writes called quoted quote quotes according reported allegedly disait dit écrit selon sagte sagt schrieb laut dijo dice escribió según".split())
THREATS = frozenset("kill hurt destroy beat stab shoot attack burn hang strangle tuer frapper détruire töten schlagen vernichten matar golpear destruir".split())

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n…|]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: Arcs of the grammar: by what the weight of a match is multiplied. The last is added where a target follows a threat.
ARCS = {"insult": 1.0, "insult_aimed": 1.5, "insult_negated": 0.3, "insult_reported": 0.4, "threat": 0.3, "threat_aimed": 1.5, "threat_negated": 0.2, "threat_reported": 0.3, "threat_then_target": 1.2}
KINDS = tuple(ARCS)


class Transducer:
    """Deterministic: ``step(state, symbol)`` gives (state, symbol); the start is 0."""

    def __init__(self, step):
        self.step = step


def _reported(state, s):
    """From a word of reporting to the clause's end, matches are reported."""
    kind = s[0]
    if kind == END:
        return 0, s
    if kind == REPORT:
        return 1, s
    return state, (kind, "reported") if state and kind in (INSULT, THREAT) else s


def _negated(state, s):
    """A negation reaches over the next three words."""
    kind, mark = s
    if kind == END:
        return 0, s
    if kind == NEGATION:
        return 3, s
    return max(0, state - 1), (kind, mark or "negated") if state and kind in (INSULT, THREAT) else s


def _aimed(state, s):
    """A target reaches over the next six words, and back to a plain threat among the three before it."""
    kind, mark = s
    near, threat = divmod(state, 4)
    if kind == END:
        return 0, s
    if kind == TARGET:
        return 6 * 4, (kind, "hit" if threat else "")
    out = (kind, mark or "aimed") if near and kind in (INSULT, THREAT) else s
    return max(0, near - 1) * 4 + (3 if out == (THREAT, "") else max(0, threat - 1)), out


def _scored(state, s):
    """A match becomes the arc that its weight goes over."""
    kind, mark = s
    if kind == TARGET and mark:
        return 0, KINDS.index("threat_then_target")
    if kind not in (INSULT, THREAT):
        return 0, None
    return 0, KINDS.index(("insult" if kind == INSULT else "threat") + (f"_{mark}" if mark else ""))


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[int]]]:
    """One machine of all: next state and feature (-1: none) by state and symbol."""
    index, todo, nexts, outs = {(0,) * len(parts): 0}, [(0,) * len(parts)], [], []
    for states in todo:
        row, said = [], []
        for kind in range(7):
            s, new = (kind, ""), []
            for part, state in zip(parts, states, strict=True):
                state, s = part.step(state, s)
                new.append(state)
            if tuple(new) not in index:
                index[tuple(new)] = len(index)
                todo.append(tuple(new))
            row.append(index[tuple(new)])
            said.append(-1 if s is None else s)
        nexts.append(row)
        outs.append(said)
    return nexts, outs


GRAMMAR = (Transducer(_reported), Transducer(_negated), Transducer(_aimed), Transducer(_scored))


def entries(word: str) -> list[str]:
    """The lexicon's keys for a word: itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def log_odds(pos: float, neg: float, prior: float) -> float:
    p = (pos + PRIOR * prior) / (pos + neg + PRIOR)
    return math.log(p / (1 - p)) - math.log(prior / (1 - prior))


class Matcher:
    """Features of texts, by a lexicon {entry: (toxic, other)} of document counts."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], prior: float):
        self.lexicon, self.prior = lexicon, prior
        self.next, self.out = compose(*GRAMMAR)
        self.seen: dict[str, float] = {}

    def weight(self, word: str, own: int | None = None) -> float:
        """own: the label of the row, which doesn't count."""
        if own is None and word in self.seen:
            return self.seen[word]
        best = 0.0
        for e in entries(word):
            if e in self.lexicon:
                pos, neg = self.lexicon[e]
                if own is not None:
                    pos, neg = pos - (own == 1), neg - (own == 0)
                if pos >= 2:
                    best = max(best, log_odds(pos, max(neg, 0), self.prior))
        best = best if best >= LEAST else 0.0
        if word in THREATS:
            best = max(best, THREAT_WEIGHT)
        if own is None:
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen[word] = best
        return best

    def features(self, text: str, own: int | None = None) -> np.ndarray:
        words = TOKEN.findall(text.lower())
        found = {w: x for w in set(words) if (x := self.weight(w, own))}
        if not found:
            return np.zeros(2)
        arcs = tuple(ARCS.values())
        state, nexts, outs, clause, threat, most, total = 0, self.next, self.out, 0.0, 0.0, 0.0, 0.0
        for w in [*words, "."]:
            kind = (THREAT if w in THREATS else INSULT) if w in found else TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTED else OTHER if w[0].isalpha() else END
            if (f := outs[state][kind]) >= 0:
                threat = found[w] if kind == THREAT else threat
                clause += arcs[f] * (found[w] if w in found else threat)
            elif kind == END and clause:
                most, total, clause = max(most, clause), total + clause, 0.0
            state = nexts[state][kind]
        return np.array([most, math.log1p(total)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method with a ridge. A step that makes the loss larger is halved."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    loss = lambda w: np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + 0.5 * w @ keep @ w
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step, now = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - y) + keep @ w), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sketch(text: str) -> int:
    """A MinHash of the text's shingles of three words."""
    import xxhash

    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict:
    """The model: lexicon, prior, weights. Its size follows from ``fit_rows``."""
    shared.lean(docs.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels["toxic"].cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("id").cast("string"))).limit(fit_rows)
    # at most fit_rows rows of two numbers
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(known), "id")

    @shared.trims
    def sketches(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([_sketch(t) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "text", "toxic", "sketch"])

    kind = rows.schema["id"].dataType.simpleString()
    sample = shared.written(rows.mapInArrow(sketches, f"id {kind}, text string, toxic int, sketch long"), "labelled")
    first = sample.groupBy("sketch", "toxic").agg(F.min("id").alias("id")).select("id").distinct()
    sample = sample.join(first, "id", "left_semi")

    @shared.trims
    def counts(batches):
        def table(n):
            found = list(n.items())
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.string()), pa.array([v if k[1] else 0 for k, v in found], pa.int64()), pa.array([0 if k[1] else v for k, v in found], pa.int64())], names=["entry", "pos", "neg"])

        n: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1), strict=True):
                y = y.as_py()
                n.update((e, y) for e in {e for w in set(TOKEN.findall(t.as_py().lower())) if w[0].isalpha() for e in entries(w)})
                if len(n) > PENDING:
                    yield table(n)
                    n.clear()
        yield table(n)

    table = sample.select("text", "toxic").mapInArrow(counts, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    one, all_ = sum(n for y, n in size.items() if y), sum(size.values())
    if not one or one == all_:
        return {"lexicon": {}, "prior": 0.5, "weights": None, "share": one / all_ if all_ else 0.5}
    prior = one / all_
    table = table.filter(f"pos >= 2 and pos > {prior} * (pos + neg) * 2")
    lexicon = {r.entry: (r.pos, r.neg) for r in table.collect()}  # of fit_rows texts
    shared_lexicon = docs.sparkSession.sparkContext.broadcast((lexicon, prior))

    @shared.trims
    def features(batches):
        m = Matcher(*shared_lexicon.value)
        for b in batches:
            x = [m.features(t, y).tolist() for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    # at most fit_rows rows of two numbers
    made = sample.select("text", "toxic").mapInArrow(features, "toxic int, x array<double>").toArrow()
    x, y = np.array(made.column("x").to_pylist()), np.array(made.column("toxic").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # so that reruns add up alike
    return {"lexicon": lexicon, "prior": prior, "weights": logistic(x[order], y[order]), "share": prior}


def _scores(model: dict):
    """A function of texts, for workers."""
    m, w, share = Matcher(model["lexicon"], model["prior"]), model["weights"], model["share"]
    if w is None:
        return lambda texts: [share for _ in texts]
    return lambda texts: [1 / (1 + math.exp(-max(-30.0, min(30.0, float(m.features(t or "") @ w[:-1] + w[-1]))))) for t in texts]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # entries of fit_rows texts

    @shared.trims
    def run(batches):
        of = _scores(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(t.as_py() for t in b.column(1)), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    shared.lean(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # entries of fit_rows texts

    def run(texts):
        of = _scores(sent.value)
        for column in texts:
            yield pa.array(of(t.as_py() for t in column), pa.float64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(run, "double")(docs[text_col]) < threshold)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
