"""Buckets in the state store against buckets of the whole window."""

import numpy as np
import pytest

from spindrift.operators.index import build_buckets
from spindrift.plans import IndexConfig
from spindrift.sources.tables import fresh_path
from spindrift.streaming.stateful import bucket_stream, run_bucket_stream


def arrive(spark, path, x, start):
    spark.createDataFrame([(start + k, [float(v) for v in r]) for k, r in enumerate(x)], "seq long, vec array<double>").repartition(3).write.mode("append").parquet(path)
    return spark.readStream.schema("seq long, vec array<double>").parquet(path)


def rows(df):
    return sorted(map(tuple, df.select("dir", "sgn", "rk", "point_id", "val").collect()))


def whole(spark, x, start, cfg):
    points = spark.createDataFrame([(start + k, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>")
    return rows(build_buckets(points, cfg))


@pytest.mark.parametrize("window", [None, 120])
def test_state_outlasts_the_query(spark, window):
    x, cfg = np.random.default_rng(13).normal(size=(300, 8)), IndexConfig(8, 8, 1, 7)
    arrivals, path = fresh_path(spark, "arrivals"), fresh_path(spark, "state")
    for start, stop in ((0, 100), (100, 180), (180, 300)):  # each run is a new query on the checkpoint
        got = run_bucket_stream(arrive(spark, arrivals, x[start:stop], start), cfg, path, window, reserve=60)
        first = 0 if window is None else max(0, stop - window)
        assert rows(got) == whole(spark, x[first:stop], first, cfg)
        assert got.filter("not complete").count() == 0 and got.select("upto").distinct().collect()[0][0] == stop - 1


def test_short_buckets_say_so(spark):
    x, cfg = np.random.default_rng(14).normal(size=(200, 4)), IndexConfig(4, 4, 1, 10)
    arrivals, path = fresh_path(spark, "arrivals"), fresh_path(spark, "state")
    run_bucket_stream(arrive(spark, arrivals, x[:100] * 5, 0), cfg, path, 100, reserve=1)
    got = run_bucket_stream(arrive(spark, arrivals, x[100:195] * 0.1, 100), cfg, path, 100, reserve=1).collect()
    want = whole(spark, np.vstack([x[95:100] * 5, x[100:195] * 0.1]), 95, cfg)
    sure = {(r["dir"], r["sgn"]) for r in got if r["complete"]}
    assert len(sure) < 8
    assert sorted((r["dir"], r["sgn"], r["rk"], r["point_id"], r["val"]) for r in got if r["complete"]) == [r for r in want if (r[0], r[1]) in sure]


def test_bad_parameters(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value as seq", "array(1D) as vec")
    for cfg, window in ((IndexConfig(1, 1, 1, 5, centering=True), None), (IndexConfig(1, 1, 1, 5), 3)):
        with pytest.raises(ValueError):
            bucket_stream(stream, cfg, window)
