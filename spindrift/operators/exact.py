"""Exact search: all queries against all points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import inner_product, l2_normalize, lift_points, lift_queries
from .topk import ranked

#: Queries travel to every task in blocks whose numbers fit in this many bytes.
QUERY_BYTES = 64 << 20
#: Scores that a task holds at a time; some six arrays of as many numbers are there at once.
SCORES = 1 << 19


def query_blocks(queries: DataFrame, numbers: int, id_col: str = "query_id") -> list[DataFrame]:
    """The queries in parts of about QUERY_BYTES at most, by a hash of their id; `numbers`: eight-byte numbers of them all."""
    parts = max(1, -(-numbers * 8 // QUERY_BYTES)) if QUERY_BYTES else 2
    return [queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [queries]


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of the k greatest of each row of scores; of equal ones the smaller ids."""
    if scores.shape[1] <= k:
        at = np.nonzero(np.ones(scores.shape, dtype=bool))
    else:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
        keep = scores >= floor
        for r in np.nonzero(keep.sum(axis=1) > k)[0]:
            tied = np.nonzero(scores[r] == floor[r])[0]
            keep[r, tied[np.argsort(ids[r, tied], kind="stable")][k - int((scores[r] > floor[r]).sum()) :]] = False
        at = np.nonzero(keep)
    return at[0], scores[at], ids[at]


def exact_search(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "dot") -> DataFrame:
    """(query_id, rank, point_id, score). points: point_id, vec; queries: query_id, vec; metric: dot, cosine or l2 (score: minus the squared distance).

    Each task scores its points against a block of queries and keeps its own k best, so at most k rows a query and task travel; more queries than fit in QUERY_BYTES
    are sent block by block, each of which reads the points again.
    """
    if metric == "cosine":
        points, queries = (d.withColumn("vec", l2_normalize(F.col("vec"))) for d in (points, queries))
    elif metric == "l2":
        norms = queries.select("query_id", inner_product(F.col("vec"), F.col("vec")).alias("q2"))
        lifted = exact_search(points.withColumn("vec", lift_points(F.col("vec"))), queries.withColumn("vec", lift_queries(F.col("vec"))), k)
        return lifted.join(norms, "query_id").withColumn("score", F.col("score") - F.col("q2")).drop("q2")
    elif metric != "dot":
        raise ValueError("metric must be dot, cosine or l2")
    size = queries.agg(F.sum(F.size("vec")).alias("n")).first()["n"] or 0
    found = None
    for part in query_blocks(queries, size):
        scored = _scored_in_tasks(points, part, k)
        found = scored if found is None else found.unionByName(scored)
    return ranked(found, k)


def _scored_in_tasks(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).collect()
    sent = points.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), np.array([r["vec"] for r in rows], dtype=float)))

    def run(batches):
        names, q = sent.value
        best = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for b in batches:
            if not len(names) or not b.num_rows:
                continue
            p = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
            if x.shape[1] != q.shape[1]:
                raise ValueError("points and queries differ in length")
            step = max(1, SCORES // (len(p) + k))
            for at in range(0, len(names), step):
                some = slice(at, at + step)
                scores = np.zeros((len(q[some]), len(p)))
                for j in range(q.shape[1]):  # in order of position, so that every formulation adds up alike
                    scores += q[some, j, None] * x[None, :, j]
                both = np.hstack([best[0][some], scores]), np.hstack([best[1][some], np.broadcast_to(p, scores.shape)])
                _, s, i = best_of(*both, k)
                best[0][some], best[1][some] = s.reshape(-1, k), i.reshape(-1, k)
        there = best[1] < np.iinfo(np.int64).max
        rows = np.nonzero(there)[0]
        yield pa.RecordBatch.from_arrays([pa.array(names[rows] if len(names) else [], pa.int64()), pa.array(best[1][there], pa.int64()), pa.array(best[0][there], pa.float64())], names=["query_id", "point_id", "score"])

    typed = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("vec").cast("array<double>").alias("vec"))
    return typed.mapInArrow(run, "query_id long, point_id long, score double")


def rerank(candidates: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, point_id) by exact inner product.

    Only ids are shuffled for the pairs: those of a point meet its vector once, queries are sent to all tasks in blocks as in exact_search, and a task passes on its k best of each query.
    """
    size = queries.agg(F.sum(F.size("vec") + 2 * k).alias("n")).first()["n"] or 0
    found = None
    for part in query_blocks(queries, size):
        some = candidates.select("query_id", "point_id")
        if part is not queries:
            some = some.join(part.select("query_id"), "query_id", "left_semi")
        # as many as the block has queries, at most
        asked = some.groupBy("point_id").agg(F.collect_list("query_id").alias("asked"))
        scored = _pairs_in_tasks(asked.join(points.select("point_id", F.col("vec").cast("array<double>").alias("vec")), "point_id").select("point_id", "vec", "asked"), part, k)
        found = scored if found is None else found.unionByName(scored)
    return ranked(found, k)


def _pairs_in_tasks(asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, score): of the points of a task with the queries that ask for them, the k best of each query."""
    rows = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).orderBy("query_id").collect()
    sent = asked.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], dtype=np.int64), np.array([r["vec"] for r in rows], dtype=float)))

    def run(batches):
        names, q = sent.value
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

        def best(query, point, score):
            order = np.lexsort((point, -score, query))
            query = query[order]
            return order[np.arange(len(order)) - np.searchsorted(query, query) < k]

        for b in batches:
            if not b.num_rows or not len(names):
                continue
            p = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)
            counts = np.diff(b.column(2).offsets.to_numpy())
            wanted = b.column(2).flatten().to_numpy(zero_copy_only=False)
            query, point = np.minimum(np.searchsorted(names, wanted), len(names) - 1), np.repeat(np.arange(len(p)), counts)
            there = names[query] == wanted
            query, point = query[there], point[there]
            if x.shape[1] != q.shape[1]:
                raise ValueError("points and queries differ in length")
            for at in range(0, len(query), SCORES // 8):
                some, of = query[at : at + SCORES // 8], point[at : at + SCORES // 8]
                score = np.zeros(len(some))
                for j in range(q.shape[1]):  # in order of position, so that every formulation adds up alike
                    score += q[some, j] * x[of, j]
                both = np.concatenate([held[0], some]), np.concatenate([held[1], p[of]]), np.concatenate([held[2], score])
                keep = best(*both)
                held = tuple(c[keep] for c in both)
        yield pa.RecordBatch.from_arrays([pa.array(names[held[0]] if len(held[0]) else [], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], names=["query_id", "point_id", "score"])

    return asked.mapInArrow(run, "query_id long, point_id long, score double")
