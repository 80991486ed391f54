"""Plans of few and of many documents, and the fit against a second solver."""

import numpy as np
import pytest

from spindrift.llm import packing


def bars_of(spark, sf):
    bars = np.zeros(packing.SEQUENCE + 1, dtype=np.int64)
    for length, n in packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).groupBy("length").count().collect():
        bars[length] = n
    return bars


@pytest.mark.parametrize("sf, most", [("sf0.01", 964), ("sf0.1", 9871)])
def test_patterns_make_most_at_every_size(spark, sf, most):
    bars = bars_of(spark, sf)
    packed = packing.plan(bars)
    patterns = dict(packing.fitted(bars, packing.SEQUENCE))
    others = sum(n for lengths, n in packed if lengths != (packing.SEQUENCE,))
    assert sum(min(n, patterns.get(lengths, 0)) for lengths, n in packed) > 0.5 * others
    assert sum(n for _, n in packed) <= most
    used = np.zeros_like(bars)
    for lengths, n in packed:
        for v in lengths:
            used[v] += n
    assert (used == bars).all()


def active_set(a, b):
    """Non-negative least squares by Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(1000):
        w = a.T @ (b - a @ x)
        if passive.all() or w[~passive].max() < 1e-9:
            return x
        passive[np.flatnonzero(~passive)[w[~passive].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                x = z
                break
            bad = passive & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
    raise AssertionError("no end")


@pytest.mark.parametrize("seed", range(5))
def test_fit_is_as_near_as_active_sets(seed):
    rng = np.random.default_rng(seed)
    bars = np.concatenate([[0], rng.integers(0, 30, 24)])
    patterns = packing.full_patterns(24)
    a = np.zeros((25, len(patterns)))
    for k, p in enumerate(patterns):
        for v in p:
            a[v, k] += v > 0
    far = lambda x: np.linalg.norm(a @ x - bars)
    bars[24] = 0
    assert far(packing.fit_counts(patterns, bars, 3000)) <= far(active_set(a, bars.astype(float))) + 1e-3
    assert far(packing.fit_counts(patterns, bars)) <= 1.1 * far(active_set(a, bars.astype(float))) + 1


def test_no_bars_and_one_bar():
    assert packing.plan(np.zeros(1025, dtype=np.int64)) == []
    for length in (1, 300, 512, 1024):
        bars = np.zeros(1025, dtype=np.int64)
        bars[length] = 7
        assert sum(n for _, n in packing.plan(bars)) == -(-7 // (1024 // length))
