"""Calibrated parameters reach their target on all queries; bounds hold; what they do not settle is searched exactly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators.exact import exact_search
from spindrift.operators.index import MipsIndex, probed_entries, recall
from spindrift.operators.tuning import calibrate, calibrated_search, certain_search, unread_bounds
from spindrift.plans import IndexConfig, QueryConfig


def table(spark, x):
    import pyarrow as pa

    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype("f8").ravel()))
    return spark.createDataFrame(pa.table({"point_id": np.arange(len(x)), "vec": flat}))


def clustered(n, per=500, spread=0.5, dim=64, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(max(10, n // per), dim))[rng.integers(0, max(10, n // per), n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def queries_of(points, every=50):
    return points.filter(f"point_id % {every} = 0").withColumnRenamed("point_id", "query_id")


@pytest.mark.parametrize("kind", ["hash", "bucket"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_target_on_the_tables(spark, sf, kind):
    p = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec")).cache()
    q, report = queries_of(p), []
    found = calibrated_search(p, q, 64, kind=kind, repeats=(2, 8), report=report)
    assert recall(found, exact_search(p, q, 10), 10).first()["recall"] >= 0.9
    assert report[0].met and report[0].cfg.top_m <= 12 * p.count() ** 0.5 + 1


def test_a_tenth_of_the_points_is_read(spark):
    p = table(spark, clustered(20_000)).repartition(4).cache()
    q, report = queries_of(p, 200), []
    found = calibrated_search(p, q, 64, repeats=(2, 8, 16), report=report)
    assert recall(found, exact_search(p, q, 10), 10).first()["recall"] >= 0.9
    assert report[0].entries < 2000


def test_a_target_out_of_reach(spark):
    p = table(spark, np.random.default_rng(0).normal(size=(3000, 32))).cache()
    got = calibrate(p, queries_of(p), 32, target=0.99, repeats=(1,), probed=(2,), root=0.5)
    assert not got.met and got.recall < 0.99 and got.cfg.top_m == 28
    assert calibrate(p, queries_of(p).limit(0), 32).met


@pytest.mark.parametrize("cfg, s", [(IndexConfig(16, 16, 2, 20), 12), (IndexConfig(16, 8, 3, 20), 20), (IndexConfig(16, 32, 1, 40), 32)])
def test_bounds_hold(spark, cfg, s):
    x = np.random.default_rng(1).normal(size=(400, 16)) * np.random.default_rng(2).uniform(0.5, 2, size=(400, 1))
    p = table(spark, x).cache()
    index, q, queries = MipsIndex.build(p, cfg, "bucket"), QueryConfig(5, s, 15), queries_of(p, 20)
    read = {(r["query_id"], r["point_id"]) for r in probed_entries(index.table, index.probe(queries, q), 15).collect()}
    bounds = {r["query_id"]: r["bound"] for r in unread_bounds(index, queries, q).collect()}
    assert len(bounds) == 20
    for i, bound in bounds.items():
        unread = [float(x[i] @ x[j]) for j in range(400) if (i, j) not in read]
        assert bound >= max(unread) - 1e-9
    short = unread_bounds(MipsIndex.build(p.limit(10), cfg, "bucket"), queries, q).collect()
    assert all(r["bound"] == float("-inf") for r in short)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_certain_search_is_exact(spark):
    # near copies of a few long vectors: the bound settles queries that find them
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 16)) * 0.05, np.repeat(rng.normal(size=(8, 16)), 30, axis=0) + 0.01 * rng.normal(size=(240, 16))])
    p = table(spark, x).cache()
    q, report = queries_of(p, 20), []
    index = MipsIndex.build(p, IndexConfig(16, 16, 1, 60), "bucket")
    assert rows(certain_search(index, q, QueryConfig(5, 16, 60), report)) == rows(exact_search(p, q, 5))
    asked, settled = report[0]
    assert asked == 112 and 0 < settled < asked
    few = MipsIndex.build(p, IndexConfig(16, 16, 1, 5000), "bucket")
    assert rows(certain_search(few, q, QueryConfig(5, 4), report)) == rows(exact_search(p, q, 5)) and report[1] == (112, 112)
