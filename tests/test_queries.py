"""Every registered vector query against its SQL."""

import math
import os

import duckdb
import pytest

from spindrift.plans import queries as vq

SF = "/root/testdata/sf0.001"


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    path = f"{SF}/embeddings.parquet"
    c.execute(f"create view embeddings as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.mark.parametrize("name", sorted(vq.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = vq.QUERIES[name](spark, SF)
    cur = con.execute(vq.ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in cur.description)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted(tuple(r[k] for k in order) for r in cur.fetchall())
    rows = sorted(tuple(r) for r in got.select(*names).collect())
    assert len(rows) == len(want) > 0
    bad = [(a, b) for a, b in zip(rows, want) if not all(map(same, a, b))]
    assert not bad, bad[:5]


@pytest.mark.parametrize("name", ["ivf_search", "ivf_pq_search"])
def test_search_without_sql(spark, name):
    rows = vq.QUERIES[name](spark, SF).collect()
    assert all(r["point_id"] == r["query_id"] for r in rows if r["rank"] == 1)
    exact = {(r["query_id"], r["point_id"]): r["score"] for r in vq.QUERIES["exact_mips_topk"](spark, SF).collect()}
    assert sum((r["query_id"], r["point_id"]) in exact for r in rows) >= 0.4 * len(exact)
    assert all(math.isclose(r["score"], exact.get((r["query_id"], r["point_id"]), r["score"]), abs_tol=2e-6) for r in rows)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["recall_dense", "recall_bucket", "recall_hash", "recall_stream"])
def test_recall_at_every_size(spark, name, sf):
    assert vq.QUERIES[name](spark, f"/root/testdata/{sf}").first()["recall"] >= 0.9


def test_no_search_pairs_all(spark):
    for name in ("dense_search", "bucket_search", "hash_search", "exact_mips_topk", "exact_l2_topk"):
        plan = vq.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
