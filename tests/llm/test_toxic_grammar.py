"""The composed machine against plain rules over words, and reported speech behind commas, colons and quotation marks."""

import random

import pytest

from spindrift.llm import toxicity as tox

LEX = tox.Lexicon({"idiot$": 1.0, "mor": 2.0})
WORDS = ["idiot", "moron", "kill", "you", "they", "not", "never", "said", "called", "tree", "walks", "green"]


def plain(text):
    """Sums by the definition: negation and targets within REACH words of a clause, reports earlier in the sentence."""
    sums = [0.0, 0.0, 0.0]
    for sentence in tox.SENTENCE.split(text.lower()):
        told = False
        for clause in tox.CLAUSE.split(sentence):
            words = tox.WORD.findall(clause)
            for k, w in enumerate(words):
                kind, weight = LEX.symbol(w)
                near = lambda names, some: any(x in names for x in some)
                if kind in "IH":
                    aimed = near(tox.TARGETS, words[max(0, k - tox.REACH) : k]) or near(tox.TARGETS, words[k + 1 : k + 1 + tox.REACH])
                    value = weight * (1.5 if aimed else 1.0) if kind == "I" else (2.0 if aimed else 0.0)
                    sums[2 if told else 1 if near(tox.NEGATIONS, words[max(0, k - tox.REACH) : k]) else 0] += value
                told |= kind == "R"
    return sums


@pytest.mark.parametrize("seed", range(8))
def test_machine_and_rules_agree(seed):
    rng = random.Random(seed)
    scorer = tox.Scorer(LEX)
    for _ in range(200):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", " ", ", ", ": ", '. "', ' "', "\n"]) for _ in range(rng.randrange(1, 25)))
        got = scorer.features(text)
        assert got[:3] == pytest.approx([__import__("math").log1p(v) for v in plain(text)]), text


@pytest.mark.parametrize("text", ['He said: "you idiot"', "She called him, an idiot", "he said idiot", 'They said, and we heard it: "idiot"'])
def test_reported(text):
    plain_, negated, reported, *_ = tox.Scorer(LEX).features(text)
    assert reported > 0 == plain_ == negated


def test_reports_end_with_the_sentence():
    assert tox.Scorer(LEX).features("He said so. You idiot")[2] == 0 < tox.Scorer(LEX).features("He said so. You idiot")[0]
    assert tox.Scorer(LEX).features("not, idiot")[1] == 0


def test_clashing_names_and_long_texts(spark, odd):
    docs = odd.withColumnRenamed("hi", "score").withColumnRenamed("s", "toxic").withColumnRenamed("b", "predicted")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    rows = tox.toxic_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    long = spark.createDataFrame([(1, "you idiot, " * 200_000), (2, "a tree. " * 200_000)], "doc_id long, text string")
    assert len(tox.toxicity(long, (LEX, __import__("numpy").ones(tox.FEATURES + 1))).collect()) == 2
