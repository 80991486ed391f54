"""Files, saved indexes, centering, validation, windows and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import __main__ as cli
from spindrift import sources
from spindrift.functions import sql
from spindrift.operators.exact import exact_search
from spindrift.operators.index import MipsIndex
from spindrift.operators.topk import to_matrix
from spindrift.plans import IndexConfig, QueryConfig
from spindrift.streaming import WindowIndex

CFG = IndexConfig(dim=8, n_proj=16, n_repeats=2, top_m=20)
X = np.random.default_rng(5).integers(-9, 10, (120, 8)).astype("<f4")


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(X)], "point_id long, vec array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(points):
    return points.filter("point_id < 10").withColumnRenamed("point_id", "query_id")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(k):
    scores = X[:10].astype(float) @ X.astype(float).T
    return {(q, r + 1, int(p), scores[q, p]) for q in range(10) for r, p in enumerate(sorted(range(len(X)), key=lambda p: (-scores[q, p], p))[:k])}


def test_files_hold_what_was_written(spark, points, tmp_path):
    want = [(k, [float(v) for v in x]) for k, x in enumerate(X)]
    sources.write_bin(points, f"file://{tmp_path}/b")
    sources.write_txt(points, f"{tmp_path}/t")
    sources.write_npy(points, f"{tmp_path}/x.npy")
    assert (np.load(tmp_path / "x.npy") == X).all()
    got = [sources.read_bin(spark, f"{tmp_path}/b", 8), sources.read_txt(spark, f"{tmp_path}/t"), sources.read_npy(spark, f"{tmp_path}/x.npy")]
    assert all(rows(d) == want for d in got)
    assert sources.read_bin(spark, f"{tmp_path}/b", 8, 7).count() == 7
    with pytest.raises(ValueError):
        sources.read_bin(spark, f"{tmp_path}/b", 8, 121)
    with pytest.raises(ValueError):
        sources.write_bin(points, "hdfs://nowhere/b")


def test_exact_search_and_its_matrix(points, queries, tmp_path, monkeypatch):
    found = exact_search(points, queries, 5)
    assert set(rows(found)) == brute(5)
    m = {r["query_id"]: r for r in to_matrix(found, 7, pad=True).collect()}
    assert all(len(r["ids"]) == len(r["scores"]) == 7 and list(r["ids"])[5:] == [0, 0] for r in m.values())
    sources.write_results(found, f"{tmp_path}/r")
    lines = [r["value"] for r in points.sparkSession.read.text(f"{tmp_path}/r").collect()]
    assert sorted(lines) == sorted(" ".join(map(str, m[q]["ids"][:5])) + " " for q in m)
    monkeypatch.setattr("spindrift.operators.exact.QUERY_BYTES", 0)  # as with more queries than are sent to tasks
    assert set(rows(exact_search(points, queries, 5))) == brute(5)


@pytest.mark.parametrize("kind", ["dense", "bucket", "hash"])
def test_saved_index_finds_the_same(points, queries, tmp_path, kind):
    cfg = IndexConfig(8, 16, 2, 20, centering=kind == "bucket")
    index, q = MipsIndex.build(points, cfg, kind), QueryConfig(5, 32, None, 120)
    found = rows(index.search(queries, q))
    index.save(f"{tmp_path}/i")
    again = MipsIndex.load(points, f"{tmp_path}/i")
    assert again.cfg.centering == cfg.centering and rows(again.search(queries, q)) == found
    # every point is a candidate of the dense form, so it is exact
    assert kind != "dense" or set(found) == brute(5)


def test_bad_parameters_and_vectors(spark, points, queries):
    for bad in (dict(dim=0), dict(dim=8, n_proj=0), dict(dim=8, top_m=0)):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    for bad in (dict(k=0), dict(n_probed_vectors=33), dict(n_probed_points=21), dict(estimator="max")):
        with pytest.raises(ValueError):
            QueryConfig(**bad).check(CFG)
    for vec in ([1.0] * 7, [None] * 8, [float("nan")] * 8, None):
        with pytest.raises(Exception, match="vectors must have 8 entries"):
            MipsIndex.build(spark.createDataFrame([(1, vec)], "point_id long, vec array<double>"), CFG).table.collect()
    assert rows(exact_search(points.limit(0), queries, 3)) == []


def test_window_slides_and_refuses(points):
    p = points.withColumnRenamed("point_id", "seq")
    old, new = p.filter("seq < 60"), p.filter("seq >= 60")
    w = WindowIndex.build(old, CFG)
    # with a full turnover nothing is lost
    a, b = (w.update(new, 60, mode) for mode in ("incremental", "rebuild"))
    assert rows(a.buckets) == rows(b.buckets) and a.points.agg(F.min("seq")).first()[0] == 60
    for args in ((new, 61), (old, 0), (None, 50), (new, -1)):
        with pytest.raises(ValueError):
            w.update(*args)


def test_ids_follow_the_order_of_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(2102, 8)).astype("<f4")
    cuts = {"a": x[:2], "b": x[2:2002], "c": x[2002:]}
    for name, part in cuts.items():
        for folder in ("t", "b"):
            (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / "t" / f"{name}.txt").write_text("\n".join(" ".join(repr(float(v)) for v in row) + ("\n  " if k % 7 == 0 else "") for k, row in enumerate(part)) + "\n")
        part.tofile(tmp_path / "b" / f"{name}.bin")
    for got in (sources.read_txt(spark, f"{tmp_path}/t"), sources.read_bin(spark, f"{tmp_path}/b", 8)):
        rows = sorted(map(tuple, got.collect()))
        assert [r[0] for r in rows] == list(range(2102))
        assert np.array_equal(np.array([r[1] for r in rows], dtype="<f4"), x)
    np.save(tmp_path / "i.npy", np.arange(12).reshape(3, 4))
    got = sources.read_npy(spark, f"{tmp_path}/i.npy")
    assert got.schema["vec"].dataType.elementType.simpleString() == "bigint" and rows_of(got) == [(k, list(range(4 * k, 4 * k + 4))) for k in range(3)]


def rows_of(df):
    return sorted((r[0], list(r[1])) for r in df.collect())


def test_vectors_from_memory(spark):
    import pandas as pd
    import pyarrow as pa

    want = [(k, [float(v) for v in x]) for k, x in enumerate(X)]
    frame = pd.DataFrame({"point_id": range(len(X)), "vec": [list(map(float, x)) for x in X], "other": 1})
    for data in (X, X.astype(float), frame, pa.Table.from_pandas(frame)):
        assert rows_of(sources.from_memory(spark, data)) == want
    with pytest.raises(ValueError):
        sources.from_memory(spark, X[0])


def test_exact_search_of_ties_and_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-2, 3, (400, 4)), rng.integers(-2, 3, (60, 4))
    points = spark.createDataFrame([(k * 3, [float(v) for v in row]) for k, row in enumerate(x)], "point_id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(q)], "query_id long, vec array<double>")
    scores = q @ x.T
    want = {(i, r + 1, int(p) * 3, float(scores[i, p])) for i in range(60) for r, p in enumerate(sorted(range(400), key=lambda p: (-scores[i, p], p))[:7])}
    assert set(rows(exact_search(points, queries, 7))) == want
    monkeypatch.setattr("spindrift.operators.exact.QUERY_BYTES", 500)
    monkeypatch.setattr("spindrift.operators.exact.SCORES", 1000)
    assert set(rows(exact_search(points, queries, 7))) == want
    plan = exact_search(points, queries, 7)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stream_window_holds_the_newest(spark, points, tmp_path):
    from spindrift.streaming import StreamingIndex

    p = points.withColumnRenamed("point_id", "seq").withColumn("seq", F.col("seq") * 5 + 2)  # ids with gaps
    sink = StreamingIndex(CFG, window=30, path=f"file://{tmp_path}/index")
    batches, at = [50, 10, 45, 15], 0
    for number, size in enumerate(batches):
        lo, at = at, at + size
        sink(p.filter((F.col("seq") >= lo * 5 + 2) & (F.col("seq") < at * 5 + 2)), number)
        seqs = sorted(r["seq"] for r in sink.state.points.collect())
        assert seqs == [k * 5 + 2 for k in range(max(0, at - 30), at)][-30:]
        assert all(r["point_id"] in seqs for r in sink.state.buckets.collect())
    # a full turnover loses nothing, so the buckets are those of the window built anew
    again = StreamingIndex(CFG, window=30, path=f"file://{tmp_path}/index")  # as a new driver would
    assert rows(again.open(spark).buckets) == rows(sink.state.buckets) and again.last == 3
    again(p.filter("seq < 50"), 3)  # a batch that comes again
    assert rows(again.state.points) == rows(sink.state.points)
    with pytest.raises(ValueError):
        StreamingIndex(CFG, window=5)


def test_stream_resumes(spark, points, tmp_path):
    from spindrift.streaming import StreamingIndex

    p = points.withColumnRenamed("point_id", "seq")
    p.filter("seq < 60").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    StreamingIndex(CFG, path=f"{tmp_path}/index").run(stream())
    p.filter("seq >= 60").write.mode("append").parquet(f"{tmp_path}/in")
    state = StreamingIndex(CFG, path=f"{tmp_path}/index").run(stream())
    assert rows(state.points.select("seq")) == [(k,) for k in range(120)]
    whole = WindowIndex.build(p, CFG)
    assert [r[:4] for r in rows(state.buckets)] == [r[:4] for r in rows(whole.buckets)]
    with pytest.raises(ValueError):
        StreamingIndex(IndexConfig(dim=8, n_proj=16, n_repeats=1, top_m=20), path=f"{tmp_path}/index").open(spark)


def test_points_of_any_age_leave(spark, points):
    p = points.withColumnRenamed("point_id", "seq")
    w = WindowIndex.build(p, CFG)
    gone = p.filter("seq % 3 = 1").select("seq")
    a, b = (w.delete(gone, mode) for mode in ("incremental", "rebuild"))
    for got in (a, b):
        assert sorted(r["seq"] for r in got.points.collect()) == [k for k in range(120) if k % 3 != 1]
        assert all(r["point_id"] % 3 != 1 for r in got.buckets.collect())
    kept = {(r["dir"], r["sgn"], r["point_id"]) for r in a.buckets.collect()}
    assert kept == {(r["dir"], r["sgn"], r["point_id"]) for r in w.buckets.collect() if r["point_id"] % 3 != 1}


def test_functions_in_sql(spark):
    sql.register(spark)
    got = spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D)), vec_norm(array(3D, 4D)), vec_pad(array(1D), 2), vec_sign(-0.5D), vec_sign(0D)").first()
    assert tuple(got) == (11.0, 5.0, [1.0, 0.0], -1, 1)


def test_table_function_searches(spark, points):
    sql.register(spark)
    points.createOrReplaceTempView("some_points")
    query = ", ".join(f"{float(v)}D" for v in X[3])
    got = spark.sql(f"select point_id, score from mips_search(points => table(select point_id, vec, point_id % 4 as part from some_points) partition by part, query => array({query}), k => 5) order by score desc, point_id limit 5")
    assert [tuple(r) for r in got.collect()] == [(p, s) for q, _, p, s in sorted(brute(5)) if q == 3]


def test_stages_are_measured(spark, points, queries):
    from spindrift.operators.metrics import compared, measured_search

    q = QueryConfig(5, 8, None, 40)
    results, stages, sizes = measured_search(points, queries, CFG, q)
    got = {r["stage"]: r for r in stages.collect()}
    assert list(got) == ["build", "probe", "candidates", "rerank", "total"] and all(r["seconds"] > 0 for r in got.values())
    assert got["probe"]["rows"] == 80 and got["build"]["rows"] == 2 * 32 * 20 and got["rerank"]["rows"] == results.count() == 50
    assert sizes.first()["n_points"] == 120 and sizes.first()["avg_candidates"] <= 40
    kinds = {r["kind"]: r for r in compared(points, queries, CFG, q).collect()}
    assert kinds["exact"]["recall"] == 1 and set(kinds) == {"exact", "dense", "bucket", "hash", "ivf", "ivf_pq"}
    assert all(0.3 < r["recall"] <= 1 and r["search_seconds"] > 0 for r in kinds.values())


@pytest.mark.parametrize("kind", ["dense", "bucket", "hash", "stream", "stream-hash"])
def test_command_line_of_each_kind(spark, points, tmp_path, kind):
    sources.write_bin(points, f"file://{tmp_path}/p")
    sources.write_bin(points.filter("point_id < 10"), f"file://{tmp_path}/q")
    more = ["--update", f"{tmp_path}/q", "--n-del", "30", "--metrics", f"{tmp_path}/m"] if kind.startswith("stream") else []
    cli.main(["--points", f"{tmp_path}/p", "--queries", f"{tmp_path}/q", "--dim", "8", "--n-proj", "32", "--top-m", "60", "--kind", kind, "--k", "3", "--n-probed-vectors", "32", "--n-cand", "120", "--out", f"{tmp_path}/o", *more])
    lines = [[int(i) for i in r["value"].split()] for r in spark.read.text(f"{tmp_path}/o").collect()]
    live = {k: X[k] for k in range(30, 120)} | {120 + k: X[k] for k in range(10)} if more else dict(enumerate(X))
    want = [sorted(live, key=lambda p: (-float(X[q].astype(float) @ live[p].astype(float)), p))[:3] for q in range(10)]
    assert len(lines) == 10 and sum(len(set(a) & set(b)) for a, b in zip(lines, want)) >= 27
    if more:
        assert {r["stage"] for r in spark.read.json(f"{tmp_path}/m").collect()} == {"build", "update", "search", "total"}


def test_command_line(spark, points, queries, tmp_path):
    points.write.parquet(f"{tmp_path}/p")
    points.filter("point_id < 10").write.parquet(f"{tmp_path}/q")
    cli.main(["--points", f"{tmp_path}/p", "--queries", f"{tmp_path}/q", "--format", "parquet", "--dim", "8", "--kind", "exact", "--k", "1", "--out", f"{tmp_path}/o"])
    best = {q: p for q, _, p, _ in brute(1)}
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/o").collect()] == [f"{best[q]} " for q in range(10)]
