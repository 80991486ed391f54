"""Product codes of residuals: estimates against NumPy, recall against plain codes of as many bytes."""

import numpy as np
import pytest

from spindrift.operators.codes import CodeIndex, Codebook
from spindrift.operators.exact import exact_search
from spindrift.operators.index import recall


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>")


@pytest.fixture(scope="module")
def skewed(spark):
    """Clusters whose entries depend on each other and have very different spreads."""
    rng = np.random.default_rng(11)
    mix = np.linalg.qr(rng.normal(size=(32, 32)))[0] * np.exp(-np.arange(32) / 6)[:, None]
    x = rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)] + 1.5 * rng.normal(size=(3000, 32)) @ mix
    return table(spark, x).repartition(5).cache()


def queries_of(p):
    return p.filter("point_id % 60 = 0").withColumnRenamed("point_id", "query_id")


def test_estimates_are_sums_of_tables(spark, skewed):
    book = Codebook.learn(skewed, parts=4, lists=6, codes=32)
    index = CodeIndex.build(skewed, book)
    rows = {r["point_id"]: r for r in index.table.collect()}
    x = {r["point_id"]: np.array(r["vec"]) for r in skewed.collect()}
    assert len(rows) == 3000
    assert np.allclose(book.rotation @ book.rotation.T, np.eye(32))
    got = index.estimates(queries_of(skewed), 2, 25).collect()
    assert len(got) == 50 * 25
    probed = {}
    for r in got:
        q, row = x[r["query_id"]], rows[r["point_id"]]
        near = min(range(6), key=lambda c: ((x[r["point_id"]] - book.centres[c]) ** 2).sum())
        made = book.centres[near] + book.rotation @ np.concatenate([book.books[p][c] for p, c in enumerate(row["codes"])])
        assert row["list"] == near and abs(r["est"] - q @ made) < 1e-9
        probed.setdefault(r["query_id"], set()).add(near)
    for i, lists in probed.items():
        assert lists <= set(np.argsort(-(book.centres @ x[i]))[:2].tolist())


def test_residuals_and_rotation_help(spark, skewed):
    q = queries_of(skewed)
    truth = exact_search(skewed, q, 10).cache()
    found = {}
    for name, rotate, residual in (("plain", False, False), ("residual", False, True), ("both", True, True)):
        index = CodeIndex.build(skewed, Codebook.learn(skewed, parts=4, lists=8, rotate=rotate, residual=residual), residual)
        found[name] = recall(index.search(q, 10, 8, 10), truth, 10).first()["recall"]
        assert recall(index.search(q, 10, 8, 300), truth, 10).first()["recall"] >= 0.9
    assert found["both"] > found["plain"] + 0.02 and found["residual"] > found["plain"] - 0.02, found


def test_score_aware_codes(spark):
    """Less error along the vectors, weighted error no greater than of plain codes, and no worse recall."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = table(spark, x).repartition(4).cache()
    q = queries_of(p)
    truth = exact_search(p, q, 10).cache()
    errors, found = {}, {}
    for along in (1.0, 4.0):
        book = Codebook.learn(p, parts=8, lists=4, codes=64, along=along)
        near, codes = book.encode(x)
        left = x - book.centres[near] - np.hstack([b[codes[:, k]] for k, b in enumerate(book.books)]) @ book.rotation.T
        main = (left * x).sum(axis=1)
        errors[along] = (main**2).mean(), (left**2).sum(axis=1).mean()
        found[along] = recall(CodeIndex.build(p, book).search(q, 10, 4, 30), truth, 10).first()["recall"]
    assert errors[4.0][0] < 0.8 * errors[1.0][0]
    assert 3 * errors[4.0][0] + errors[4.0][1] <= 3 * errors[1.0][0] + errors[1.0][1]
    assert found[4.0] >= found[1.0] - 0.02, found


def test_few_points_and_bad_parameters(spark, skewed):
    few = skewed.filter("point_id < 3")
    index = CodeIndex.build(few, Codebook.learn(few, parts=2, lists=4, codes=8))
    q = queries_of(skewed).limit(2)
    assert sorted(map(tuple, index.search(q, 5, 4, 10).collect())) == sorted(map(tuple, exact_search(few, q, 5).collect()))
    for bad in (dict(parts=5), dict(codes=300), dict(along=0.5)):
        with pytest.raises(ValueError):
            Codebook.learn(skewed, **bad)
    with pytest.raises(ValueError):
        Codebook.learn(skewed.limit(0))
