"""A graph of near neighbours, built by joins with bounded lists, and a beam search in it.

The graph starts from blocks of points that are neighbours in the order of their products with random directions, in which each point keeps its best. A round looks, for each point, at its neighbours and at as many of the points that have it as a neighbour (of least hash, so that a
point that many have costs no more than others), and offers each of these the best of the others; lists keep the k best. Rounds end when few lists change. Likeness is the cosine.

A search keeps the `beam` best points of each query, at first of a fixed number of starting points, and in each round joins the graph to the best of them that it has not followed yet; candidates are scored by inner product. It ends when the beam holds nothing new.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inner_product, l2_normalize
from ..sources.tables import stored
from .exact import rerank
from .rotation import vectors_of
from .topk import top_per_group

BLOCK, ORDERS, ROUNDS = 48, 4, 8
#: Of the points of a list, how many are offered to each.
OFFERED = 4
#: The share of new edges under which rounds end.
SETTLED = 0.01
_EDGES = "node long, other long, score double"


def _best(ids: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, other, score): for each row the `count` greatest products with the others; of equal ones the smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    scores = x @ x.T
    scores[ids[:, None] == ids[None, :]] = -np.inf
    count = min(count, len(ids) - 1)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :count]
    rows = np.repeat(np.arange(len(ids)), count)
    got = scores[rows, top.ravel()]
    there = got > -np.inf
    return ids[rows][there], ids[top.ravel()][there], got[there]


def _batch(parts: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["node", "other", "score"])


def _blocks(k: int, dim: int):
    def run(batches):
        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, dim))
        for b in batches:
            ids, x = np.append(ids, b.column(0).to_numpy(zero_copy_only=False)), np.vstack([x, vectors_of(b.column(1), dim)])
            whole = len(ids) // BLOCK * BLOCK
            if whole:
                yield _batch([_best(ids[at : at + BLOCK], x[at : at + BLOCK], k) for at in range(0, whole, BLOCK)])
            ids, x = ids[whole:], x[whole:]
        if len(ids) > 1:
            yield _batch([_best(ids, x, k)])

    return run


def _offers(dim: int):
    def run(batches):
        for b in batches:
            parts = []
            for row in b.column(0).to_pylist():
                parts.append(_best(np.array([r["other"] for r in row], dtype=np.int64), np.array([r["vec"] for r in row]).reshape(len(row), dim), OFFERED))
            if parts:
                yield _batch(parts)

    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k best of each node, repeated edges once."""
    return top_per_group(edges.groupBy("node", "other").agg(F.max("score").alias("score")), ["node"], [F.desc("score"), F.col("other")], k)


def neighbour_graph(points: DataFrame, dim: int, k: int = 16, rounds: int = ROUNDS, seed: int = 42, report: list | None = None) -> DataFrame:
    """(node, other, score, rank), a table: k near points of each point, at most. report: gets the share of new edges of each round."""
    unit = stored(points.select(F.col("point_id").cast("long").alias("point_id"), l2_normalize(F.col("vec")).alias("vec")))
    rng, edges = np.random.default_rng(seed), None
    for _ in range(ORDERS):
        along = unit.withColumn("at", inner_product(F.col("vec"), F.lit([float(v) for v in rng.normal(size=dim)])))
        some = along.repartitionByRange("at", "point_id").sortWithinPartitions("at", "point_id").select("point_id", "vec").mapInArrow(_blocks(k, dim), _EDGES)
        edges = some if edges is None else edges.unionByName(some)
    graph = stored(_lists(edges, k))
    for _ in range(rounds):
        back = top_per_group(graph.select(F.col("other").alias("node"), F.col("node").alias("other")), ["node"], [F.xxhash64("node", "other"), F.col("other")], k, "turn")
        near = graph.select("node", "other").unionByName(back.select("node", "other")).distinct()
        # 2 k points a node at most
        lists = near.join(unit.withColumnRenamed("point_id", "other"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "vec")).alias("list"))
        offers = lists.select("list").mapInArrow(_offers(dim), _EDGES)
        new = stored(_lists(graph.select("node", "other", "score").unionByName(offers), k))
        share = new.join(graph, ["node", "other"], "left_anti").count() / max(1, new.count())
        graph = new
        if report is not None:
            report.append(share)
        if share < SETTLED:
            break
    return graph


def graph_search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int = 10, beam: int = 32, starts: int = 32, followed: int = 4, rounds: int = 20, report: list | None = None) -> DataFrame:
    """(query_id, rank, point_id, score). report: gets the points that were scored, over all queries, for each round."""
    if beam < k:
        raise ValueError("the beam must hold k points")
    first = points.select("point_id").orderBy(F.xxhash64("point_id"), "point_id").limit(starts)
    asked = queries.select("query_id").crossJoin(F.broadcast(first))  # a fixed number of starting points for each query
    seen = stored(asked)
    best = stored(rerank(seen, points, queries, beam))
    done = best.select("query_id", "point_id").limit(0)
    for _ in range(rounds):
        if report is not None:
            report.append(seen.count())
        fresh = top_per_group(best.join(done, ["query_id", "point_id"], "left_anti"), ["query_id"], [F.col("rank")], followed, "turn").select("query_id", "point_id")
        fresh = stored(fresh)
        if fresh.isEmpty():
            break
        done = stored(done.unionByName(fresh))
        met = fresh.join(graph.select(F.col("node").alias("point_id"), "other"), "point_id").select("query_id", F.col("other").alias("point_id")).distinct()
        new = stored(met.join(seen, ["query_id", "point_id"], "left_anti"))
        seen = stored(seen.unionByName(new))
        found = rerank(new, points, queries, beam).unionByName(best)
        best = stored(top_per_group(found.drop("rank"), ["query_id"], [F.desc("score"), F.col("point_id")], beam).select("query_id", "rank", "point_id", "score"))
    return best.filter(F.col("rank") <= k)
