"""Exact search by cells against exact search over all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators.bounded import Cells, bounded_search
from spindrift.operators.exact import exact_search


def points_of(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "point_id long, vec array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def norms(spark, sf_dir):
    return scaled(spark, sf_dir, 1)


def scaled(spark, sf_dir, power):
    """Lengths of 1 to 7, to a power."""
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    scale = F.pow(F.col("vec_id") % 7 + 1, F.lit(float(power)))
    return p.select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda x: x * scale).alias("vec")).cache()


@pytest.mark.parametrize("power, share", [(1, 0.95), (3, 0.7)])
def test_long_points_are_enough(spark, sf_dir, power, share):
    norms = scaled(spark, sf_dir, power)
    q = norms.filter("point_id % 50 = 0").withColumnRenamed("point_id", "query_id")
    report = []
    assert rows(bounded_search(norms, q, 10, report, ranges=8, pivots=4)) == rows(exact_search(norms, q, 10))
    queries, cells, read, scored = (sum(c) for c in zip(*report))
    assert scored < share * queries * norms.count() and read < share * queries * cells


def test_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(12, 16)), 200, axis=0) + 0.05 * rng.normal(size=(2400, 16))
    p = points_of(spark, x)
    q = p.filter("point_id % 40 = 0").withColumnRenamed("point_id", "query_id")
    report = []
    assert rows(bounded_search(p, q, 5, report, ranges=3, pivots=12)) == rows(exact_search(p, q, 5))
    assert sum(r[3] for r in report) < 0.5 * 60 * 2400


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ties_zeros_and_few_points(spark, k):
    x = [[0, 0, 0], [1, 0, 0], [1, 0, 0], [-1, 0, 0], [2, 0, 0], [0, 3, 0], [0, 3, 0], [0, 0, -1], [-2, -2, -2]] * 3
    p = points_of(spark, x, [7 * i % 27 for i in range(27)])
    q = points_of(spark, [[1, 0, 0], [-1, -1, 0], [0, 0, 0], [0, 0, 5]]).withColumnRenamed("point_id", "query_id")
    assert rows(bounded_search(p, q, k)) == rows(bounded_search(p, q, k, ranges=3, pivots=4)) == rows(exact_search(p, q, k))


def test_no_points_no_queries_bad_vectors(spark):
    p = points_of(spark, [[1.0, 2.0]])
    none = p.limit(0)
    assert bounded_search(none, p.withColumnRenamed("point_id", "query_id")).collect() == []
    assert bounded_search(p, none.withColumnRenamed("point_id", "query_id")).collect() == []
    with pytest.raises(Exception):
        bounded_search(p, points_of(spark, [[1.0]]).withColumnRenamed("point_id", "query_id")).collect()


def test_cells_are_pruned(spark, norms):
    cells = Cells.build(norms)
    plan = cells.points.filter("cell in (3, 4) and length >= 2.0")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan and "GreaterThanOrEqual(length,2.0)" in plan
    assert cells.directory[:, 1].sum() == norms.count()
