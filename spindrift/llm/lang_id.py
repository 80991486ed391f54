"""Language identification as inference of a mixture.

A language is a smoothed distribution of letter trigrams within words, learned from a bounded sample of labelled
documents (SAMPLE documents a language, those with the smallest hash of id). Each document is a mixture of
languages: expectation-maximisation over its words (weighted by how often they occur) estimates the proportions, and a language
joins the set only if it raises the log-likelihood by more than the penalty of half the log of the word count a parameter times PENALTY.
The prediction is the language of the largest proportion.

Defined cases: text that is null or has no letter gives `und` with score 0; very long texts are counted whole; rows with null lang and rows without id only take
part in prediction; with nothing to learn from, every document is `und`; ties go to the first language in alphabetical order;
repeated rows get equal predictions; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text

#: Labelled documents to learn from, for each language.
SAMPLE = 1500
#: Trigrams kept for each language, its most frequent in the sample, so that a small language loses none to a large one.
GRAMS = 50_000
PENALTY = 4.0
SALTS = 64
#: The ids of the sample are sent to all tasks if they are counted to be no more than this.
BROADCAST_ROWS = 100_000
CACHED = 1_000_000
WORDS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k : k + 3] for k in range(len(w) - 2)]


def held_out(id_col: str, parts: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == remainder


def _count(batches):
    counts: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for word, n in Counter(WORDS.findall(text.lower())).items():
                for g in trigrams(word):
                    counts[lang, g] += n
    keys = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
        names=["lang", "gram", "n"],
    )


class LanguageModel:
    def __init__(self, langs: list[str], grams: dict[str, int], logp: np.ndarray, unseen: np.ndarray):
        self.langs, self.grams, self.logp, self.unseen = langs, grams, logp, unseen

    @classmethod
    def from_counts(cls, rows: list[tuple[str, str, int]], alpha: float = 0.5) -> LanguageModel:
        langs = sorted({r[0] for r in rows})
        grams = {g: k for k, g in enumerate(sorted({r[1] for r in rows}))}
        counts = np.zeros((len(grams), len(langs)))
        for lang, g, n in rows:
            counts[grams[g], langs.index(lang)] = n
        total = counts.sum(axis=0) + alpha * (len(grams) + 1)
        return cls(langs, grams, np.log((counts + alpha) / total), np.log(alpha / total))

    def word(self, word: str) -> np.ndarray:
        out = np.zeros(len(self.langs))
        for g in trigrams(word):
            k = self.grams.get(g)
            out += self.unseen if k is None else self.logp[k]
        return out


def _mixture(like: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood; like has a row per distinct word, scaled to a largest value of 1."""
    pi, total, last = start, n.sum(), -np.inf
    for _ in range(rounds):
        mixed = np.maximum(like @ pi, 1e-300)
        value = float(n @ np.log(mixed))
        if value - last < 1e-4 * max(1.0, abs(value)):
            break
        last = value
        pi = pi * (like.T @ (n / mixed)) / total
    return pi, value


def proportions(scores: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportion of each language; the set grows while the penalised likelihood does."""
    top = scores.max(axis=1, keepdims=True)
    like, size = np.exp(scores - top), scores.shape[1]
    chosen = [int(np.argmax(n @ (scores - top)))]
    best = float(n @ (scores[:, chosen[0]] - top[:, 0]))
    pi = np.ones(1)
    cost = penalty * 0.5 * np.log(max(2.0, n.sum()))
    while len(chosen) < size:
        trials = []
        # no mixture is likelier on a word than its likeliest language, so a language that can't gain the cost even so is left out
        most = scores[:, chosen].max(axis=1)
        for k in range(size):
            if k not in chosen:
                gain_bound = float(n @ (np.maximum(most, scores[:, k]) - top[:, 0])) - best
                if gain_bound > cost:
                    trials.append((gain_bound, k))
        found = None
        for _, k in sorted(trials, key=lambda t: (-t[0], t[1])):
            p, value = _mixture(like[:, chosen + [k]], n, np.append(pi * 0.8, 0.2))
            if value - best > cost and (found is None or value > found[1]):
                found = (p, value, k)
        if found is None:
            break
        pi, best = found[0], found[1]
        chosen.append(found[2])
    out = np.zeros(size)
    out[chosen] = pi / pi.sum()
    return out


def learn(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    light = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    light = light.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col)).alias("h"))
    # the smallest hashes of each language, first within SALTS parts of it, so that one common language isn't one task's
    for keys in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("h", "id")
        light = light.withColumn("salt", F.pmod("h", F.lit(SALTS))).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample)
    picked = stored(light.select(F.col("lang").alias("__l"), F.col("id").alias("__i")).distinct())
    if picked.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    texts = texts.join(picked, (F.col("lang") == F.col("__l")) & (F.col("id") == F.col("__i")), "left_semi").select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # at most GRAMS rows a language, from a bounded sample
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("k") <= GRAMS)
    rows = [tuple(r) for r in best.select("lang", "gram", "n").collect()]
    return LanguageModel.from_counts(rows) if rows else None


def _predictor(model: LanguageModel | None, penalty: float):
    def run(batches):
        langs = model.langs if model else []
        room = max(1000, CACHED // max(1, len(langs)))
        known: dict[str, int] = {}
        table = np.zeros((1024, max(1, len(langs))))
        for b in batches:
            preds, scores, shares = [], [], []
            for text in b.column(1).to_pylist():
                counts = Counter(WORDS.findall(text.lower()))
                # some signs that count as word characters, as ², are no letters
                if not langs or not any(c.isalpha() for word in counts for c in word):
                    preds.append(UNDETERMINED), scores.append(0.0), shares.append("")
                    continue
                if len(known) > room:
                    known.clear()
                at = np.empty(len(counts), dtype=np.int64)
                for j, word in enumerate(counts):
                    k = known.get(word)
                    if k is None:
                        k = known[word] = len(known)
                        if k >= len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[k] = model.word(word)
                    at[j] = k
                pi = proportions(table[at], np.fromiter(counts.values(), dtype=float), penalty)
                best = int(np.argmax(pi))
                preds.append(langs[best]), scores.append(float(min(1.0, pi[best])))
                shares.append(",".join(f"{langs[k]}:{pi[k]:.3f}" for k in np.argsort(-pi, kind="stable") if pi[k] > 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.string())],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return run


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the proportion of lang_pred), mixture."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_predictor(model, penalty), "doc_id long, lang_pred string, score double, mixture string")


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from documents whose crc32 remainder by 3 is not 1, predict all; adds held_out."""
    out = held_out(id_col, 3, 1)
    model = learn(docs, ~out, id_col, text_col, lang_col)
    found = identify(docs, model, id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.25) -> DataFrame:
    """The rows with a language that makes up at least `least` of the document; their columns are unchanged."""
    small_batches(docs.sparkSession)
    model = learn(docs, ~held_out(id_col, 3, 1), id_col, text_col, lang_col)
    run = _predictor(model, PENALTY)

    @F.pandas_udf("boolean")
    def passes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(texts):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
            return batch

        for found in run(one(p) for p in parts):
            pred, score = found.column(1).to_pylist(), found.column(2).to_pylist()
            yield pd.Series([p != UNDETERMINED and s >= least for p, s in zip(pred, score)], dtype=bool)

    return docs.filter(passes(whole_text(text_col)))
