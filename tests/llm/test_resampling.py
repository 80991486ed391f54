import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from spindrift.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, runs=1):
    words = WORD.findall((text or "").translate(LOW))
    return words, [" ".join(words[k : k + n]) for n in range(1, runs + 1) for k in range(len(words) - n + 1)]


def plain(docs, target, runs=1, buckets=10_000):
    """{place: (doc_id, n_features, weight, score, rank)} of (doc_id, text) rows with ids."""
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(place(f) for x in some for f in features(x, runs)[1]) for some in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + buckets) / ((s[b] + 1.0) * (sum(t.values()) + buckets))))
    rows = []
    for i, x in docs:
        words, found = features(x, runs)
        weight = sum(gain(place(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    able = sorted((-r[3], r[0] is None, r[0] or 0, k) for k, r in enumerate(rows) if r[4])
    ranks = {k: n for n, (*_, k) in enumerate(able[: len(able) * 10 // 100], 1)}
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(rows)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("runs", [1, 3])
def test_plain_python(spark, sf_dir, docs, texts, runs):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = rows_of(resampling.resampling_weights(docs, target, runs=runs))
    want = plain(list(texts.items()), [r["text"] for r in target.collect()], runs)
    assert got == sorted(want, key=str) and sum(r[4] is not None for r in got) >= 10


def test_odd_tables(spark, odd, none, sf_dir):
    target = spark.createDataFrame([(None,), ("",), ("Some words that go on; the same TEXT ÉtÉ",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = rows_of(resampling.resampling_weights(odd, target))
    assert got == sorted(plain(rows, [r["text"] for r in target.collect()]), key=str)
    assert rows_of(resampling.resampling_weights(none, target)) == []
    assert len(rows_of(resampling.resampling_weights(odd, target.limit(0)))) == len(rows)


def test_ties_and_ranges(spark):
    """Equal scores of one id, in more ranges than one; places go on without gaps, whichever the row."""
    text = "word " * 25
    docs = spark.createDataFrame([(k % 400, text) for k in range(2000)], "doc_id long, text string").repartition(7)
    got = resampling.resampling_weights(docs, docs.limit(3)).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in got)


def test_drawn_rows_keep_their_columns(spark, odd, sf_dir):
    docs = odd.filter("doc_id is not null and length(text) > 100").dropDuplicates(["doc_id"])
    drawn = resampling.resample(docs, docs.select("text"), percent=50)
    assert drawn.columns == docs.columns and drawn.count() == docs.count() * 50 // 100 - 0 or drawn.count() <= docs.count()
    assert drawn.subtract(docs).count() == 0


def test_plan_holds_one_literal_and_no_python(spark, docs):
    made = spark.createDataFrame([(1, [0, 1])], "doc_id long, buckets array<int>")
    plan = resampling.scores(docs, docs.limit(5))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and made.count() == 1
