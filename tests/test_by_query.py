"""Searches give the same rows whether buckets are sent to tasks or joined."""

import numpy as np
import pytest

from spindrift.operators import index as ix
from spindrift.plans import IndexConfig, QueryConfig
from spindrift.streaming import WindowIndex


@pytest.mark.parametrize("kind, estimator", [("bucket", "sum"), ("bucket", "mean"), ("hash", "sum")])
def test_sent_and_joined(spark, monkeypatch, kind, estimator):
    x = np.random.default_rng(15).normal(size=(500, 8))
    p = spark.createDataFrame([(3 * k - 40, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>").cache()
    q = p.filter("point_id % 20 = 2").withColumnRenamed("point_id", "query_id")
    index, conf = ix.MipsIndex.build(p, IndexConfig(8, 8, 2, 30), kind), QueryConfig(5, 6, 20, 40, estimator)
    window = WindowIndex.build(p.withColumnRenamed("point_id", "seq"), index.cfg)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())
    one = [rows(index.candidates(q, conf)), rows(index.search(q, conf)), rows(window.search(q, conf, "hash" if kind == "hash" else "estimate"))]
    monkeypatch.setattr(ix, "INDEX_BYTES", 0)
    two = [rows(index.candidates(q, conf)), rows(index.search(q, conf)), rows(window.search(q, conf, "hash" if kind == "hash" else "estimate"))]
    assert one == two and len(one[0]) > 100
    assert index.candidates(q.limit(0), conf).collect() == []
