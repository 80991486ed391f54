"""The neighbour graph against exact neighbours, and the beam search in it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators.exact import exact_search
from spindrift.operators.graph import graph_search, neighbour_graph
from spindrift.operators.index import recall


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "point_id long, vec array<double>")


def test_graph_and_search(spark):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p, report = table(spark, x).repartition(4).cache(), []
    graph = neighbour_graph(p, 16, 12, report=report)
    rows = graph.collect()
    want = x @ x.T - 2 * np.eye(1500)
    near = np.argsort(-want, axis=1)[:, :12]
    got = {}
    for r in rows:
        assert r["node"] != r["other"] and abs(r["score"] - want[r["node"], r["other"]]) < 1e-9
        got.setdefault(r["node"], []).append(r["other"])
    assert all(len(v) == len(set(v)) == 12 for v in got.values()) and len(got) == 1500
    assert np.mean([len(set(got[k]) & set(near[k].tolist())) / 12 for k in got]) > 0.8
    assert len(report) <= 8 and report[-1] < report[0]
    q = p.filter("point_id % 60 = 0").withColumnRenamed("point_id", "query_id")
    seen = []
    found = graph_search(graph, p, q, 10, beam=40, report=seen)
    assert recall(found, exact_search(p, q, 10), 10).first()["recall"] >= 0.9
    assert seen[-1] < 0.6 * 25 * 1500
    with pytest.raises(ValueError):
        graph_search(graph, p, q, 10, beam=5)


def test_few_points_and_equal_points(spark):
    p = table(spark, [[1, 0], [1, 0], [1, 0], [0, 2], [0, 0]])
    graph = {(r["node"], r["rank"]): r["other"] for r in neighbour_graph(p, 2, 2).collect()}
    assert graph[0, 1] == 1 and graph[0, 2] == 2 and graph[1, 1] == 0 and graph[2, 1] == 0 and len(graph) == 10
    q = p.filter("point_id in (0, 3)").withColumnRenamed("point_id", "query_id")
    assert sorted(map(tuple, graph_search(neighbour_graph(p, 2, 2), p, q, 3).collect())) == sorted(map(tuple, exact_search(p, q, 3).collect()))
    assert neighbour_graph(p.limit(0), 2).collect() == [] == neighbour_graph(p.filter(F.col("point_id") == 1), 2).collect()
