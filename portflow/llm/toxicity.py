"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults with a weight (learned), threats, targets, negations and reported-speech words (small
fixed lists), clause ends. Five little transducers read the symbols: each has a few states and puts a factor on the
weight of a hit. They are composed into one product transducer whose arcs multiply the factors; a clause scores the
sum of its weighted hits, so a negated or quoted insult counts less, one aimed at a target more, and a threat counts
only with a target in its clause. A document's score is a logistic function of its clause scores.

Learning (``train``) uses labelled rows outside the held-out fold, at most ``SAMPLE`` of them, chosen by a hash of the
id. Insults are words, or word beginnings of 4 to 6 letters, whose log-odds between toxic and other documents stay
over ``LOWEST`` by two standard errors; both counts are taken by Spark over the sampled documents. The logistic part is
fitted on a fold that the insults were not learned from.

Edge cases: null or empty texts score as texts without a hit; documents without a label are scored alike; labels
that repeat a doc_id count as toxic if one of them is; a corpus without usable labels gives a model without insults
and one score for all; null doc_ids are never held out and never learned from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, stored, tidy

SAMPLE = 30_000  # labelled rows to learn from, at most
LOWEST = 1.5  # least log-odds, less two standard errors, of an insult
TERMS = 5_000  # strongest insults kept (words and beginnings), out of at most 20 times as many candidates
SUPPORT = 3  # toxic documents that hold an insult, at least
BEGINNINGS = (4, 5, 6)

# Seed words of the grammar.
THREATS = "kill hurt destroy beat punch shoot stab burn attack töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours he she him her they them these those people du dich dir euch ihr sie ihn tu toi vous ils elles lui tú usted ustedes ellos ellas él ella".split()
NEGATIONS = "not never no without hardly nicht nie kein keine ohne ne pas jamais sans nunca sin tampoco".split()
REPORTS = "said says called quoted wrote reported claimed alleged sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

NONE, END, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
INSULT_AT, THREAT_AT = 7, 8  # a hit with a target after it in its clause
HITS = (INSULT, THREAT, INSULT_AT, THREAT_AT)
_TOKEN = re.compile(r"[^\W_]+|[.,;:!?\n]")


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) -> (state, factor); what has no arc keeps the state and the factor 1."""

    arcs: dict = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))


def _reset(states: int) -> dict:
    return {(s, END): (0, 1.0) for s in range(states)}


# Each counts words only as far as it must; state 0 is the start of a clause.
INSULTS = Transducer(_reset(1))  # a hit passes with its weight
AIMED = Transducer(_reset(2) | {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.3)} | {(s, INSULT_AT): (s, 1.3) for s in range(2)})
THREATENED = Transducer(_reset(2) | {(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.0), (1, THREAT): (1, 1.0)})
NEGATED = Transducer(_reset(4) | {(s, NEGATION): (3, 1.0) for s in range(4)} | {(s, x): (s - 1, 1.0) for s in (1, 2, 3) for x in (NONE, TARGET, REPORT)} | {(s, x): (s - 1, 0.4) for s in (1, 2, 3) for x in HITS})
REPORTED = Transducer(_reset(2) | {(0, REPORT): (1, 1.0)} | {(1, x): (1, 0.6) for x in HITS})
# Read from the right: a target marks the hits before it, up to the clause's beginning.
AHEAD = {(0, TARGET): 1, (1, END): 0}
MARKED = {INSULT: INSULT_AT, THREAT: THREAT_AT}


def look_ahead(symbols: list[int]) -> list[int]:
    """Symbols with the hits marked that a target follows in their clause."""
    out, state = list(symbols), 0
    for i in range(len(out) - 1, -1, -1):
        x = out[i]
        state = AHEAD.get((state, x), state)
        if state and x in MARKED:
            out[i] = MARKED[x]
    return out


class Composition:
    """The product of transducers: states are tuples, factors multiply; arcs are made when first taken."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.arcs: dict = {}

    def clauses(self, symbols: list[int], weights: list[float]) -> list[float]:
        """Scores of the clauses with a hit."""
        state, total, hit, out = (0,) * len(self.parts), 0.0, False, []
        for x, w in zip([*symbols, END], [*weights, 0.0]):
            arc = self.arcs.get((state, x))
            if arc is None:
                steps = [p.step(s, x) for p, s in zip(self.parts, state)]
                arc = self.arcs[state, x] = (tuple(s for s, _ in steps), math.prod(f for _, f in steps))
            state = arc[0]
            if x in HITS:
                total += w * arc[1]
                hit = True
            elif x == END and hit:
                out.append(total)
                total, hit = 0.0, False
        return out


@dataclass
class Model:
    words: dict[str, float]
    beginnings: dict[str, float]
    coefficients: list[float]  # bias, log1p of the sum, the largest clause, log1p of the clauses with a hit

    def features(self) -> "Features":
        return Features(self)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + x @ np.array(self.coefficients[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class _Symbols(dict):
    """Word -> (symbol, weight); words of no class share one value and are not kept."""

    def __init__(self, model: Model):
        super().__init__({x: (END, 0.0) for x in ".,;:!?\n"})
        self.model, self.none = model, (NONE, 0.0)
        for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.update({w: (kind, 0.0) for w in words})
        self.update({w: (THREAT, 2.0) for w in THREATS})
        self.update({w: (INSULT, x) for w, x in model.words.items()})

    def __missing__(self, word: str):
        b = self.model.beginnings
        w = max((b.get(word[:k], 0.0) for k in BEGINNINGS if len(word) >= k), default=0.0)
        return (INSULT, w) if w else self.none


class Features:
    def __init__(self, model: Model):
        self.symbols = _Symbols(model)
        self.grammar = Composition(INSULTS, AIMED, THREATENED, NEGATED, REPORTED)

    def __call__(self, text: str | None) -> tuple[float, float, float]:
        seen = list(map(self.symbols.__getitem__, _TOKEN.findall((text or "").lower())))
        if not any(x[0] == INSULT or x[0] == THREAT for x in set(seen)):
            return 0.0, 0.0, 0.0
        kinds, weights = zip(*seen)
        scores = [s for s in self.grammar.clauses(look_ahead(kinds), weights) if s > 0]
        return math.log1p(sum(scores)), max(scores, default=0.0), math.log1p(len(scores))


def _counts(docs: DataFrame, known: set[str] | None) -> DataFrame:
    """(term, toxic documents, other documents) of words and beginnings (marked by a star); summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            terms = list(c[0].keys() | c[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([c[1][t] for t in terms], pa.int64()), pa.array([c[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])
            c[0].clear(), c[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = set(_TOKEN.findall((text.as_py() or "").lower()))
                terms = words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}
                c[toxic].update(terms if known is None else terms & known)
                if len(c[toxic]) > 200_000:
                    yield flush()
        yield flush()

    return docs.select("text", "toxic").mapInArrow(tidy(count), "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fold(doc_id):
    """The fold of a document: crc32 of its id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> list[float]:
    """Newton's method with a ridge; x are few columns of at most ``SAMPLE`` rows."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); never from fold 0."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold("doc_id")).where("fold <> 0")
    picked = F.broadcast(stored(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled"))  # at most ``sample`` rows
    rows = stored(docs.select("doc_id", "text").join(picked, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "fold"), "train")
    learn, fit = rows.where("fold < 4"), rows.where("fold = 4")
    sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    if n1 and n0:
        odds = lambda a, b: math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        top = _counts(learn.where("toxic = 1"), None).where(F.col("toxic") >= SUPPORT).orderBy(F.desc("toxic"), "term").limit(20 * terms).collect()
        in_toxic = {r.term: r.toxic for r in top if odds(r.toxic, 0) > LOWEST}
        in_other = {r.term: r.other for r in _counts(learn.where("toxic = 0"), set(in_toxic)).collect()}
        best = sorted(((odds(a, in_other.get(t, 0)), t) for t, a in in_toxic.items()), reverse=True)[:terms]
        for x, t in best:
            if x > LOWEST:
                (beginnings if t.endswith("*") else words)[t.rstrip("*")] = x
    model = Model(words, beginnings, [-2.0, 0.0, 0.0, 0.0])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.features()
        for b in batches:
            x = [f(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in x], pa.float64()) for i in range(3)] + [b.column(1).cast(pa.float64())], names=["a", "b", "c", "y"])

    got = np.array(fit.select("text", "toxic").mapInArrow(tidy(vectors), "a double, b double, c double, y double").collect(), float).reshape(-1, 4)
    if 0 < got[:, 3].sum() < len(got):
        model.coefficients = _logistic(got[:, :3], got[:, 3])
    return model


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``name`` (0 to 1) set; all rows and all other columns stay."""
    return docs.withColumn(name, arrow_column(_scorer(model), "double")("text"))


def _scorer(model: Model):
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = model.features()
        for texts in batches:
            yield pa.array(model.probability(np.array([f(x.as_py()) for x in texts], float).reshape(-1, 3)))

    return probability
