"""Searches whose candidates are a share of the points, on more points than the given tables have, against NumPy; and the steps that find that share."""

import numpy as np
import pytest

from spindrift.operators import index as ix
from spindrift.operators import exact, shares
from spindrift.operators.exact import rerank
from spindrift.operators.ivf import ivf_pq_search, ivf_search
from spindrift.operators.rotation import project_batch
from spindrift.plans import IndexConfig, QueryConfig
from spindrift.plans import queries as vq

N = 3000


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    x = np.random.default_rng(3).normal(size=(N, 64)).astype(np.float32)
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, x.astype(float)


def best(est, n, score, k=10):
    """The k best scores among the n best estimates (-inf: none)."""
    order = [i for i in np.lexsort((np.arange(len(est)), -est))[:n] if est[i] > -np.inf]
    return sorted(order, key=lambda i: (-score[i], i))[:k]


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["point_id"])
    return out


def signs(y, s):
    top = np.lexsort((np.arange(len(y)), -abs(y)))[:s]
    return top, np.where(y[top] < 0, -1.0, 1.0)


def test_dense_search_scores_a_fifth(spark, made):
    path, x = made
    proj, got = project_batch(x, vq.CFG), found(vq.QUERIES["dense_search"](spark, path))
    for q in range(0, N, 50):
        dirs, s = signs(proj[q], 64)
        assert got[q] == best((proj[:, dirs] * s).sum(axis=1), N // 5, x @ x[q])


def test_rebuilt_buckets_hold_a_fifth(spark, made):
    got = vq.QUERIES["stream_update_rebuild"](spark, made[0])
    assert got.count() == 256 * (N // 5) and got.agg({"rk": "max"}).first()[0] == N // 5


def test_centred_hash_search_reads_a_tenth(spark, made, monkeypatch):
    path, x = made
    mean = x.mean(axis=0)
    proj, asked = project_batch(x - mean, vq.CFG), project_batch(x, vq.CFG)
    one = found(vq.QUERIES["hash_search_centered"](spark, path))
    for q in range(0, N, 50):
        held = {i for d, s in zip(*signs(asked[q], 16)) for i in np.argsort(-s * proj[:, d], kind="stable")[: N // 10]}
        assert one[q] == sorted(held, key=lambda i: (-(x[i] @ x[q]), i))[:10]
    monkeypatch.setattr(ix, "INDEX_BYTES", 0)  # as for larger buckets
    assert found(vq.QUERIES["hash_search_centered"](spark, path)) == one


def test_codes_score_a_fifth(spark, made):
    path, x = made
    c = x[[i for i in range(N) if i % vq.GIVEN == 0][:16]]
    near = lambda y, m: ((m * m).sum(axis=1) - 2 * y @ m.T).argmin(axis=1)
    lists, codes = near(x, c), np.stack([near(x[:, j : j + 8], c[:, j : j + 8]) for j in range(0, 64, 8)], axis=1)
    got = found(vq.QUERIES["ivf_pq_given"](spark, path))
    for q in range(0, N, 50):
        est = sum((c[codes[:, j], 8 * j : 8 * j + 8] * x[q, 8 * j : 8 * j + 8]).sum(axis=1) for j in range(8))
        est[~np.isin(lists, np.argsort(-(c @ x[q]), kind="stable")[:8])] = -np.inf
        assert got[q] == best(est, N // 5, x @ x[q])


@pytest.mark.parametrize("sample, bins", [(1, 1), (40, 3)])
def test_share_is_exact_whatever_the_sample(spark, monkeypatch, sample, bins):
    """With copies of points, blocks of queries, and bins that are too wide or beside the place."""
    monkeypatch.setattr(shares, "SAMPLE", sample)
    monkeypatch.setattr(shares, "BINS", bins)
    monkeypatch.setattr(exact, "QUERY_BYTES", 0)
    x = np.random.default_rng(8).integers(-2, 3, size=(300, 8)).astype(float)
    x[100:180] = x[100]
    p = spark.createDataFrame([(7 * k - 50, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>").cache()
    q = p.filter("pmod(point_id, 11) = 2").withColumnRenamed("point_id", "query_id")
    index = ix.MipsIndex.build(p, IndexConfig(8, 8, 2, 30), "dense")
    for n_cand in (5, 60, 300):
        conf = QueryConfig(5, 6, None, n_cand)
        assert found(index.search(q, conf)) == found(rerank(index.candidates(q, conf), p, q, 5))
    assert index.search(q.limit(0), conf).collect() == []
    assert ivf_search(p, q.limit(0), 3, centres=x[:4].tolist()).collect() == []
    assert len(found(ivf_pq_search(p, q, 3, 4, 1, 2, 4, 2, centres=x[:4].tolist(), codebooks=[x[:4, :4].tolist(), x[:4, 4:].tolist()]))) > 0


def test_exact_search_holds_few_scores(spark, monkeypatch):
    """A task's arrays for 1,000 queries and a batch of 10,000 points, as large as batches get."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from spindrift.operators.exact import exact_search

    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1000)], "query_id long, vec array<double>")
    points = queries.withColumnRenamed("query_id", "point_id")
    kind, runs = type(points), []
    made = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *a, **k: (runs.append(run), made(self, run, *a, **k))[1])
    exact_search(points, queries, 10)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(10_001, dtype=np.int32) * 8), pa.array(rng.normal(size=80_000)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors], names=["point_id", "vec"])
    tracemalloc.start()
    got = list(runs[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 10_000
    assert peak < 40e6


def test_pairs_take_little_more_than_their_scores_in_files(spark, tmp_path):
    """Ids of pairs of 10,000 points, a whole batch, with 50 queries; and each pair once."""
    import pyarrow.parquet as pq

    points = spark.range(10_000, numPartitions=1).selectExpr("id * 7 as point_id", "array(double(id), 1d) as vec")
    pairs = shares.inner_products(points, points.filter("point_id % 1400 = 0").withColumnRenamed("point_id", "query_id"))
    pairs.write.parquet(f"{tmp_path}/pairs")
    size = 0
    for f in (tmp_path / "pairs").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        size += sum(m.row_group(g).column(c).total_compressed_size for g in range(m.num_row_groups) for c in (0, 1))
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == 500_000
    assert got.filter("score != query_id / 7 * point_id / 7 + 1").isEmpty()
    assert size < 0.3 * 500_000


def test_runs_of_entries_with_fewer_centres_than_others(spark):
    """Codebooks of one to five centres, as k-means makes them where a run of entries has few values: estimates against NumPy."""
    x = np.random.default_rng(8).integers(-3, 4, (120, 4)).astype(float)
    books = [[[-2.0], [0.0], [2.0], [3.0], [1.0]], [[1.0]], [[-1.0], [1.0]], [[0.0], [2.0], [-3.0]]]
    points = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "point_id long, vec array<double>")
    queries = points.filter("point_id < 10").withColumnRenamed("point_id", "query_id")
    got = found(ivf_pq_search(points, queries, 3, n_probes=1, n_cand=20, centres=[[0.0] * 4], codebooks=books))
    near = np.stack([np.array(b)[abs(x[:, j, None] - np.array(b)[:, 0]).argmin(axis=1), 0] for j, b in enumerate(books)], axis=1)
    for q in range(10):
        assert got[q] == best(near @ x[q], 20, x @ x[q], 3)
