"""Candidates by bounds against candidates by whole sums."""

import numpy as np
import pytest

from spindrift.operators.index import MipsIndex, best_candidates, bucket_estimates
from spindrift.operators.threshold import entries_of_all, threshold_candidates
from spindrift.plans import IndexConfig, QueryConfig


def rows(df):
    return sorted((r["query_id"], r["rank"], r["point_id"], round(r["est"], 6)) for r in df.collect())


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>")


@pytest.mark.parametrize("n_cand", [1, 5, 60])
@pytest.mark.parametrize("s", [1, 4])
def test_same_candidates(spark, n_cand, s):
    rng = np.random.default_rng(s)
    # a few long points head every bucket
    x = rng.normal(size=(1500, 8)) * np.where(np.arange(1500)[:, None] % 100 == 0, 12, 1)
    p = table(spark, x).cache()
    index = MipsIndex.build(p, IndexConfig(8, 8, 2, 600), "bucket").cache()
    probed = index.probe(p.filter("point_id % 150 = 3").withColumnRenamed("point_id", "query_id"), QueryConfig(1, s))
    report = []
    got = threshold_candidates(index.table, probed, 600, n_cand, report=report)
    assert rows(got) == rows(best_candidates(bucket_estimates(index.table, probed, 600), n_cand))
    read, every = sum(r[2] for r in report), entries_of_all(index.table, probed, 600)
    assert read <= every and (read < every / 2 or n_cand == 60)
    index.clear()


def test_small_buckets_ties_and_values_below_zero(spark):
    x = np.random.default_rng(9).integers(-1, 2, size=(40, 4))
    p = table(spark, x).cache()
    for top_m in (3, 17, 100):
        index = MipsIndex.build(p, IndexConfig(4, 4, 1, top_m), "bucket")
        probed = index.probe(p.filter("point_id < 6").withColumnRenamed("point_id", "query_id"), QueryConfig(1, 3))
        for n_cand in (1, 7, 500):
            assert rows(threshold_candidates(index.table, probed, top_m, n_cand, first=2, growth=2)) == rows(best_candidates(bucket_estimates(index.table, probed, top_m), n_cand))
    none = probed.limit(0)
    assert threshold_candidates(index.table, none, top_m, 3).collect() == []
