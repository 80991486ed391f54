"""Tables of a streaming index: merged when they are many, found again by a new sink, and old ones removed."""

import numpy as np

import spindrift.streaming as streaming
from spindrift.plans import IndexConfig
from spindrift.sources.tables import fresh_path, names_in


def points_of(spark, x, start):
    return spark.createDataFrame([(start + k, [float(v) for v in r]) for k, r in enumerate(x)], "seq long, vec array<double>")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(streaming, "PARTS", 3)
    x = np.random.default_rng(12).normal(size=(150, 8))
    cfg, path = IndexConfig(8, 8, 1, 5), fresh_path(spark, "parts")
    sink, most = streaming.StreamingIndex(cfg, window=70, mode="rebuild", path=path), 0
    for b in range(10):
        sink(points_of(spark, x[15 * b : 15 * b + 15], 15 * b), b)
        most = max(most, len(sink.parts))
        if b == 6:  # as after the loss of the driver
            sink = streaming.StreamingIndex(cfg, window=70, mode="rebuild", path=path)
            assert sink.open(spark).points.count() == 70
    assert most <= 3
    assert rows(sink.state.points) == rows(points_of(spark, x[80:], 80))
    assert rows(sink.state.buckets) == rows(streaming.WindowIndex.build(points_of(spark, x[80:], 80), cfg).buckets)
    live = {f"version={v:012d}" for v in sink._versions()}
    assert len(names_in(spark, f"{path}/version=*")) <= len(live) + 4
    assert sink.parts and max(sink.parts.values()) == 149
