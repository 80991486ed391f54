"""Estimated candidate counts against counted ones."""

import numpy as np
import pytest

from spindrift.operators.index import MipsIndex, hash_candidates
from spindrift.operators.sketches import bucket_sketches, estimated_candidates, narrowed, probes_within
from spindrift.plans import IndexConfig, QueryConfig


@pytest.fixture(scope="module")
def made(spark):
    x = np.random.default_rng(16).normal(size=(4000, 8))
    p = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>").cache()
    index = MipsIndex.build(p, IndexConfig(8, 8, 4, 300), "hash").cache()
    return index, index.probe(p.filter("point_id % 100 = 0").withColumnRenamed("point_id", "query_id"), QueryConfig(10, 16)).cache()


def counts(index, probed, prefix):
    got = {}
    for r in hash_candidates(index.table, probed, prefix).collect():
        got[r["query_id"]] = got.get(r["query_id"], 0) + 1
    return got


@pytest.mark.parametrize("prefix", [40, 300])
def test_within_the_error_of_the_sketch(made, prefix):
    index, probed = made
    want = counts(index, probed, prefix)
    got = {r["query_id"]: r["candidates"] for r in estimated_candidates(bucket_sketches(index.table, prefix), probed).collect()}
    assert got.keys() == want.keys() and len(got) == 40
    assert max(abs(got[q] / want[q] - 1) for q in got) < 4 * 1.04 / 64


def test_probes_of_a_budget(made):
    index, probed = made
    sketches, steps = bucket_sketches(index.table), [2, 4, 8, 16]
    chosen = probes_within(sketches, probed, 1500, steps)
    rows = {r["query_id"]: r for r in chosen.collect()}
    assert len(rows) == 40 and len({r["n_probed_vectors"] for r in rows.values()}) > 1
    want = counts(index, narrowed(probed, chosen), 300)
    assert all(want[q] < 1500 * 1.07 for q in rows)
    for q, r in rows.items():
        bigger = [s for s in steps if s > r["n_probed_vectors"]]
        if bigger:
            more = counts(index, probed.filter(f"query_id = {q} and rk <= {bigger[0]}"), 300)[q]
            assert more > 1500 * 0.93
            break
    least = probes_within(sketches, probed, 1, steps)
    assert {r["n_probed_vectors"] for r in least.collect()} == {2}
    assert probes_within(sketches, probed.limit(0), 10, steps).collect() == []
