"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into sentences, a sentence at commas and colons into clauses, and each word becomes a symbol: insult, threat, target, negation, reported speech or other; the cut between clauses is a symbol too.
Three transducers over these symbols are composed into one machine: negation marks the insults and threats in its reach, reported
speech marks what follows its verb in the sentence, also behind a comma, a colon or quotation marks, and the scorer sums lexical weights, raised where a target stands close by.
Negation and targets reach to the end of a clause, so what counts is matched clauses, not words alone.

The closed classes (threat verbs, targets, negations, verbs of saying) are fixed lists; the insult class is learned: words and word stems that
a bounded sample of labelled documents (MAX_POSITIVE and MAX_NEGATIVE, by smallest hash of id) has far more often in toxic documents. A logistic
regression on the sums of plain, negated and reported clause scores, the best clause and the number of matched clauses gives the score.

Defined cases: null text counts as empty and scores as a text without matches; null labels are left out; a document with
several labels counts as toxic if one is 1; with labels of one class only, every score is 0; rows without id are scored but not learned from;
repeated rows get equal scores; very long texts are read whole, sentence by sentence; entries that tie in weight are taken by their count, then in alphabetical order; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .lang_id import held_out

MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
#: Learned entries: at least so many toxic documents, so many times the benign rate, so many entries.
LEAST_DOCS, LEAST_RATIO, MAX_ENTRIES = 5, 20.0, 2_000
STEM = range(3, 11)
REACH = 3

# Closed word classes in English, French, German and Spanish.
THREATS = {"kill", "hurt", "destroy", "beat", "stab", "shoot", "punch", "tuer", "frapper", "töten", "schlagen", "umbringen", "matar", "golpear"}
TARGETS = {"you", "your", "he", "she", "they", "them", "tu", "toi", "vous", "ils", "du", "dich", "dir", "ihr", "sie", "usted", "ellos", "ustedes"}
NEGATIONS = {"not", "no", "never", "isn", "don", "ne", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "jamás"}
REPORTS = {"said", "says", "called", "wrote", "claimed", "quoted", "dit", "appelé", "sagte", "nannte", "schrieb", "dijo", "llamó", "escribió"}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?;\n|]+")
CLAUSE = re.compile(r"[:,]+")
CACHED = 400_000
FEATURES = 5


class Transducer:
    """A deterministic machine: step(state, symbol) -> (state, symbol out). States are small tuples, symbols strings."""

    def __init__(self, start, step):
        self.start, self._step, self._known = start, step, {}

    def step(self, state, symbol):
        got = self._known.get((state, symbol))
        if got is None:
            got = self._known[state, symbol] = self._step(state, symbol)
        return got

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out is what the other takes in."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)


#: The cut between two clauses of a sentence.
CUT = "C"


def negation() -> Transducer:
    def step(left, s):
        if s == CUT:
            return 0, s
        if s == "N":
            return REACH, s
        return max(0, left - 1), s + "-" if left and s in ("I", "H") else s

    return Transducer(0, step)


def reported() -> Transducer:
    def step(inside, s):
        return int(inside or s == "R"), s + '"' if inside and s[0] in "IH" else s

    return Transducer(0, step)


def targeting() -> Transducer:
    """Marks insults and threats within REACH of a target before them."""

    def step(left, s):
        if s == CUT:
            return 0, s
        if s == "T":
            return REACH, s
        return max(0, left - 1), s + ">" if left and s[0] in "IH" else s

    return Transducer(0, step)


GRAMMAR = negation().then(reported()).then(targeting())


class Lexicon:
    def __init__(self, entries: dict[str, float]):
        """entries: weight by stem, or by whole word if it ends in $."""
        self.entries = entries
        self.lengths = sorted({len(e) for e in entries if not e.endswith("$")})

    def symbol(self, word: str) -> tuple[str, float]:
        weight = max([self.entries.get(word + "$", 0.0), *(self.entries.get(word[:k], 0.0) for k in self.lengths if k <= len(word))])
        if weight > 0:
            return "I", weight
        for s, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in words:
                return s, 1.0
        return "O", 0.0


def clause_scores(clause: list[str], lexicon: Lexicon) -> tuple[float, float, float]:
    """Scores of plain, negated and reported matches in a clause alone."""
    return _scored(clause, lexicon)[0]


def _scored(clause: list[str], lexicon: Lexicon, state=None) -> tuple[tuple[float, float, float], tuple]:
    """Scores of plain, negated and reported matches in a clause, and the state that the next clause of the sentence begins in; state: that of the clause before."""
    state, sums = GRAMMAR.start if state is None else GRAMMAR.step(state, CUT)[0], [0.0, 0.0, 0.0]
    symbols = [lexicon.symbol(w) for w in clause]
    after = [any(s == "T" for s, _ in symbols[k + 1 : k + 1 + REACH]) for k in range(len(symbols))]
    for (s, weight), near in zip(symbols, after):
        state, out = GRAMMAR.step(state, s)
        if out[0] in "IH":
            # a threat needs a target; without one it is an ordinary verb
            aimed = ">" in out or near
            value = weight * (1.5 if aimed else 1.0) if out[0] == "I" else (2.0 if aimed else 0.0)
            sums[2 if '"' in out else 1 if "-" in out else 0] += value
    return tuple(sums), state


class Scorer:
    """Features of texts; words are classified once while they are remembered."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.hot, self.cold = lexicon, set(), set()

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = set(WORD.findall(low))
        if len(self.cold) > CACHED:
            self.cold.clear()
        for w in words - self.cold - self.hot:
            (self.hot if self.lexicon.symbol(w)[0] in "IH" else self.cold).add(w)
        out = [0.0] * FEATURES
        if words & self.hot:
            for sentence in SENTENCE.split(low):
                if self.hot.isdisjoint(WORD.findall(sentence)):
                    continue
                state = None
                for clause in CLAUSE.split(sentence):
                    got, state = _scored(WORD.findall(clause), self.lexicon, state)
                    out = [out[0] + got[0], out[1] + got[1], out[2] + got[2], max(out[3], got[0]), out[4] + (sum(got) > 0)]
        return [math.log1p(v) for v in out]


def entries_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w + "$" for w in words} | {w[:k] for w in words for k in STEM if k <= len(w)}


def _count_entries(among: set[str] | None):
    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(entries_of(text) if among is None else entries_of(text) & among)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["entry", "n"])

    return run


def learn_lexicon(sample: DataFrame, positive: int, negative: int) -> Lexicon:
    """sample: text, toxic. The shortest stem stands for those it covers."""

    def counted(toxic: int, among: set[str] | None, least: int):
        got = sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(_count_entries(among), "entry string, n long")
        got = got.groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        return {r["entry"]: r["n"] for r in got.orderBy(F.desc("n"), "entry").limit(20 * MAX_ENTRIES).collect()}

    toxic = counted(1, None, LEAST_DOCS)
    benign = counted(0, set(toxic), 1)
    entries: dict[str, float] = {}
    stems: dict[str, int] = {}
    for e in sorted(toxic, key=lambda e: (len(e.rstrip("$")), e)):
        rate = ((toxic[e] + 0.5) / (positive + 1)) / ((benign.get(e, 0) + 0.5) / (negative + 1))
        word = e.rstrip("$")
        if rate >= LEAST_RATIO and not any(word[:k] in stems for k in STEM if k <= len(word)):
            entries[e] = math.log(rate) / math.log(LEAST_RATIO)
            if not e.endswith("$"):
                stems[e] = toxic[e]
    best = sorted(entries, key=lambda e: (-entries[e], -toxic[e], e))[:MAX_ENTRIES]
    return Lexicon({e: entries[e] for e in best})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, reg = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + reg
        step = np.linalg.solve(hess, a.T @ (y - p) - reg @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text") -> tuple[Lexicon, np.ndarray] | None:
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    marks = (marks if usable is None else marks.filter(usable)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("__id"), F.col("__id"))
    picked = marks.filter("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(MAX_NEGATIVE))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), whole_text(text_col).alias("text"))
    sample = stored(rows.join(F.broadcast(picked), "__id").select("text", "toxic"))  # at most MAX_POSITIVE + MAX_NEGATIVE ids
    n = defaultdict(int, {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()})
    if not n[0] or not n[1]:
        return None
    lexicon = learn_lexicon(sample, n[1], n[0])
    got = sample.mapInArrow(_features(lexicon), "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).collect()
    data = np.array([list(r) for r in got], dtype=float)
    return lexicon, fit_logistic(data[:, 1:], data[:, 0])


def _features(lexicon: Lexicon):
    def run(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = np.array([scorer.features(t) for t in b.column(0).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["toxic", *(f"x{k}" for k in range(FEATURES))])

    return run


def _scores(model):
    def run(batches):
        scorer = Scorer(model[0]) if model else None
        for b in batches:
            texts = b.column(1).to_pylist()
            if model:
                x = np.array([scorer.features(t) for t in texts]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(x @ model[1][:-1] + model[1][-1], -30, 30)))
            else:
                score = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from labels whose crc32 remainder by 5 is not 0, score all: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, ~held_out(id_col, 5, 0), id_col, text_col)
    out = F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out")
    return toxicity(docs, model, id_col, text_col).select("doc_id", out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
