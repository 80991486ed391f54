import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import mining

NAMES = "vec_id long, embedding array<float>, label int, id long, name string, place int, pack int, score double, vec string"


def brute(rows, every=50):
    """rows: (id, vector, label) after all conditions, repeated rows once."""
    out = []
    rows = [(i, np.array(v), y) for i, v, y in rows]
    for a, q, y in rows:
        if a % every:
            continue
        score = lambda v: int(sum(x * z for x, z in zip(q.tolist(), v.tolist())))
        others = sorted((-score(v), i, z) for i, v, z in rows if i != a)
        for p, pid, _ in [o for o in others if o[2] == y][:5]:
            some = [(s, i) for s, i, z in others if z != y and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(some, 1)]
    return sorted(out)


def prepared(rows):
    seen = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        seen[i, y, tuple(math.floor(256 * np.float32(x).astype(float)) for x in v)] = None
    return [(i, v, y) for i, y, v in seen]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "n", 1, 2, 0.5, "v") for r in rows], NAMES)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_odd_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).astype("f4").tolist(), int(rng.integers(0, 3))) for k in range(0, 700)]
    rows += rows[:60]  # repeated rows
    rows += [(1000 + k, rows[50][1], k % 3) for k in range(120)]  # equal vectors
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2050, [1.0, None] * 3, 1), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 0), (2200, rows[3][1], None)]
    rows += [(2250, [0.0] * 6, 1), (2300, [], 2), (2350, [1.5], 0), (2400, [9.0] * 6, 7), (100, [2.0] * 6, 1)]
    want = brute(prepared(rows))
    assert got(mining.mined(frame(spark, rows))) == want and len(want) > 100
    mixed = mining.usable(frame(spark, rows)).withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert got(mining.hard_negatives(mixed, F.col("id") % 50 == 0, segment=16, pack=4)) == want
    assert mining.mined(frame(spark, rows[:0])).collect() == []
    assert mining.mined(frame(spark, [(0, [1.0], 1)])).collect() == [] and mining.mined(frame(spark, [(1, [1.0], 1)])).collect() == []


def test_far_intervals_are_not_read(spark):
    """On clusters most intervals are left unread, and nothing is missed."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 8)) * 4
    rows = [(k, (middle[k % 20] + rng.normal(size=8) * 0.1).tolist(), k % 20 // 2) for k in range(6000)]
    report = []
    points = mining.usable(frame(spark, rows))
    found = mining.hard_negatives(points, F.col("id") % 50 == 0, segment=64, pack=8, report=report)
    ids = [(i, [math.floor(256 * np.float32(x).astype(float)) for x in v], y) for i, v, y in rows]
    assert got(found) == brute(ids)
    packs = -(-120 // 8)
    assert sum(now for now, _ in report) < 0.6 * 2 * packs * (6000 / 64) and report[-1][1] == 0


def test_too_long(spark):
    with pytest.raises(ValueError):
        mining.mined(frame(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)]))


def test_k_means_of_few_rows():
    assert mining.learn_pivots(np.zeros((1, 3))).shape == (1, 3)
