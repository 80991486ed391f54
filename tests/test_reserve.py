"""Windows with a reserve against windows whose buckets are made anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.plans import IndexConfig, QueryConfig
from spindrift.streaming import WindowIndex
from spindrift.streaming.reserve import ReserveWindow


def points_of(spark, x, start=0):
    return spark.createDataFrame([(start + k, [float(v) for v in r]) for k, r in enumerate(x)], "seq long, vec array<double>")


def rows(df):
    return sorted(map(tuple, df.select("dir", "sgn", "rk", "point_id", "val").collect()))


@pytest.mark.parametrize("centering", [False, True])
def test_ten_slides(spark, centering):
    rng = np.random.default_rng(6)
    cfg, x = IndexConfig(8, 8, 2, 10, centering=centering), rng.normal(size=(400, 8))
    window = ReserveWindow.build(points_of(spark, x[:200]), cfg)
    rebuilt = WindowIndex.build(points_of(spark, x[:200]), cfg)
    lossy, refilled, lost = rebuilt, [], 0
    for k in range(200, 400, 20):
        new = points_of(spark, x[k : k + 20], k)
        window, rebuilt, lossy = window.update(new, 20), rebuilt.update(new, 20, "rebuild").settled(), lossy.update(new, 20).settled()
        assert rows(window.buckets) == rows(rebuilt.buckets)
        refilled.append(window.refilled)
        lost += rows(lossy.buckets) != rows(rebuilt.buckets)
    assert lost > 0 and sum(refilled) < 32 * 10 / 4
    q = points_of(spark, x[:5]).withColumnRenamed("seq", "query_id")
    for kind in ("estimate", "hash"):
        assert sorted(map(tuple, window.search(q, QueryConfig(3, 4, None, 20), kind).collect())) == sorted(map(tuple, rebuilt.search(q, QueryConfig(3, 4, None, 20), kind).collect()))


@pytest.mark.parametrize("reserve", [0, 3, 1000])
def test_shrinking_ties_and_full_turnover(spark, reserve):
    x = np.random.default_rng(7).integers(-1, 2, size=(120, 4))
    cfg = IndexConfig(4, 4, 1, 6)
    window = ReserveWindow.build(points_of(spark, x[:60]), cfg, reserve)
    rebuilt = WindowIndex.build(points_of(spark, x[:60]), cfg)
    for new, n_del in ((None, 25), (points_of(spark, x[60:70], 60), 0), (None, 30), (points_of(spark, x[70:110], 70), 15), (points_of(spark, x[110:], 110), 40)):
        window, rebuilt = window.update(new, n_del), rebuilt.update(new, n_del, "rebuild")
        assert rows(window.buckets) == rows(rebuilt.buckets)
        if reserve == 1000:
            assert window.refilled == 0
    with pytest.raises(ValueError):
        window.update(None, 10_000)
    with pytest.raises(ValueError):
        ReserveWindow.build(points_of(spark, x), cfg, -1)
