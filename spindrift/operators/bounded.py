"""Exact search that leaves out points whose scores are bounded from above: by the Cauchy-Schwarz inequality and by the angle to a pivot.

Points lie in cells: RANGES ranges of their length, cut at its quantiles, and in each the points of the least angle to one of PIVOTS directions, which come from a bounded sample. A cell knows its number of points, its least and greatest length
and its greatest angle to the pivot, so a query at angle t of the pivot has no score above |q| |x| cos(max(0, t - greatest angle)) there. The table is sorted by cell and falling length and partitioned by cell, so cells that are left out
are not opened, and of the others row groups of too short points are skipped by their statistics.

A search reads the FIRST cells of each query in order of their bounds, and GROWTH times as many each round, until no cell's bound reaches the k-th score; then what was found is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checked, norm2
from ..sources.tables import fresh_path, stored
from .exact import SCORES, best_of, query_blocks
from .rotation import vectors_of
from .topk import ranked

#: Ranges and pivots at most, and points of a mean cell at least: small tables have fewer cells.
RANGES, PIVOTS, CELL = 16, 16, 256
SAMPLE, ROUNDS = 4096, 8
FIRST, GROWTH = 4, 4
#: Bounds are wider by this share, as lengths and angles are rounded.
SLACK = 1e-7
_ROWS = "point_id long, vec array<double>, length double, cell int, angle double"


def _directions(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions of the means of a sample's groups of near directions."""
    x = _directions(sample)
    centres = x[:: max(1, len(x) // count)][:count].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        for k in np.unique(near):
            mean = x[near == k].sum(axis=0)
            if mean.any():
                centres[k] = mean / np.linalg.norm(mean)
    return centres


@dataclass
class Cells:
    """points: point_id, vec, length, cell; directory: a row per cell (cell, n, least length, greatest length, greatest angle)."""

    points: DataFrame
    pivots: np.ndarray
    directory: np.ndarray

    @classmethod
    def build(cls, points: DataFrame, dim: int | None = None, ranges: int | None = None, pivots: int | None = None) -> Cells:
        """The table goes to the shared folder. An empty table has no cells."""
        points = checked(points, "vec", dim)
        typed = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("vec").cast("array<double>").alias("vec")).withColumn("length", F.sqrt(norm2(F.col("vec"))))
        sample = [r["vec"] for r in typed.select("point_id", "vec").orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE).collect()]
        if not sample:
            return cls(typed.withColumn("cell", F.lit(0)), np.zeros((1, dim or 1)), np.zeros((0, 5)))
        sides = math.ceil(math.sqrt(typed.count() / CELL))
        ranges, pivots = ranges or min(RANGES, sides), pivots or min(PIVOTS, sides)
        centres = _pivots(np.array(sample, dtype=float), pivots)
        got = typed.agg(F.percentile_approx("length", [k / ranges for k in range(1, ranges)], 10_000).alias("q")).first()["q"] if ranges > 1 else []
        cuts, width = np.unique(np.array(got, dtype=float)), len(centres)

        def placed(batches):
            for b in batches:
                if b.num_rows:
                    cosines = _directions(vectors_of(b.column(1), centres.shape[1])) @ centres.T
                    near = cosines.argmax(axis=1)
                    # long points first; equal lengths lie in one range
                    part = len(cuts) - np.searchsorted(cuts, b.column(2).to_numpy(zero_copy_only=False), side="left")
                    angle = np.arccos(np.clip(cosines[np.arange(len(near)), near], -1, 1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part * width + near, pa.int32()), pa.array(angle)], names=["point_id", "vec", "length", "cell", "angle"])

        path = fresh_path(points.sparkSession, "cells")
        order = [F.col("cell"), F.desc("length"), F.col("point_id")]
        typed.mapInArrow(placed, _ROWS).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("cell").parquet(path)
        table = points.sparkSession.read.schema(_ROWS).parquet(path)
        rows = table.groupBy("cell").agg(F.count("*").alias("n"), F.min("length").alias("low"), F.max("length").alias("high"), F.max("angle").alias("angle")).collect()
        return cls(table.drop("angle"), centres, np.array(sorted(map(tuple, rows)), dtype=float))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score of a query (row) in a cell (column) is greater."""
        length = np.linalg.norm(q, axis=1)[:, None]
        angles = np.arccos(np.clip(_directions(q) @ self.pivots.T, -1, 1))[:, self.directory[:, 0].astype(int) % len(self.pivots)]
        cosine = np.cos(np.maximum(0, angles - self.directory[:, 4])) + SLACK
        return length * np.where(cosine > 0, self.directory[:, 3], self.directory[:, 2]) * cosine * (1 + np.sign(cosine) * SLACK)

    def search(self, queries: DataFrame, k: int = 10, report: list | None = None) -> DataFrame:
        """(query_id, rank, point_id, score), the same rows as exact_search. report: gets (queries, cells, pairs of both that were read, points of these pairs) for each block of queries."""
        found = None
        dim = self.pivots.shape[1]
        queries = checked(queries, "vec", dim if len(self.directory) else None)
        for part in query_blocks(queries, queries.count() * (dim + len(self.directory))):
            some = self._block(part, k, report)
            found = some if found is None else found.unionByName(some)
        return found

    def _block(self, queries: DataFrame, k: int, report: list | None) -> DataFrame:
        spark = queries.sparkSession
        rows = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).collect()  # QUERY_BYTES at most
        names = np.array([r["query_id"] for r in rows], dtype=np.int64)
        if not len(names) or not len(self.directory):
            return spark.createDataFrame([], "query_id long, rank int, point_id long, score double")
        q = np.array([r["vec"] for r in rows], dtype=float)
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        limit, read, found, upto = np.full(len(names), -np.inf), np.zeros(bound.shape, dtype=bool), None, FIRST
        while True:
            now = (bound >= limit[:, None]) & ~read & (place < upto)
            if now.any():
                new = _scored(self.points, self.directory[:, 0].astype(int), names, q, now, limit, k)
                found = stored(ranked(new if found is None else new.unionByName(found.drop("rank")), k))
                read |= now
                # the k-th scores of a block of queries
                got = dict(found.filter(F.col("rank") == k).select("query_id", "score").collect())
                limit = np.array([got.get(n, -np.inf) for n in names.tolist()])
            if not ((bound >= limit[:, None]) & ~read).any():
                break
            upto *= GROWTH
        if report is not None:
            report.append((len(names), bound.shape[1], int(read.sum()), int((read * self.directory[:, 1]).sum())))
        return found


def _scored(points: DataFrame, cells: np.ndarray, names: np.ndarray, q: np.ndarray, wanted: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
    """(query_id, point_id, score): the k best of a task for each query among the cells that it wants, if they reach its limit."""
    spark = points.sparkSession
    sent = spark.sparkContext.broadcast((names, q, np.packbits(wanted, axis=0), limit))  # bounded by the block of queries

    def run(batches):
        names, q, bits, limit = sent.value
        wanted = np.unpackbits(bits, axis=0, count=len(names)).astype(bool)
        length = np.linalg.norm(q, axis=1)
        best = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            ids, own = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            x, size = vectors_of(b.column(1), q.shape[1]), b.column(2).to_numpy(zero_copy_only=False)
            for cell in np.unique(own):
                here = np.flatnonzero(own == cell)
                for_cell = np.flatnonzero(wanted[:, np.searchsorted(cells, cell)])
                step = max(1, SCORES // (len(here) + k))
                for at in range(0, len(for_cell), step):
                    some = for_cell[at : at + step]
                    floor = np.maximum(limit[some], best[0][some].min(axis=1))
                    some = some[length[some] * size[here].max() * (1 + SLACK) >= floor]
                    if not len(some):
                        continue
                    scores = np.zeros((len(some), len(here)))
                    for j in range(q.shape[1]):  # in order of position, so that every formulation adds up alike
                        scores += q[some, j, None] * x[None, here, j]
                    both = np.hstack([best[0][some], scores]), np.hstack([best[1][some], np.broadcast_to(ids[here], scores.shape)])
                    _, s, i = best_of(*both, k)
                    best[0][some], best[1][some] = s.reshape(-1, k), i.reshape(-1, k)
        there = (best[1] < np.iinfo(np.int64).max) & (best[0] >= limit[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(names[np.nonzero(there)[0]], pa.int64()), pa.array(best[1][there], pa.int64()), pa.array(best[0][there], pa.float64())], names=["query_id", "point_id", "score"])

    # no point of a shorter length reaches any query's limit
    least = np.min(np.where(np.isfinite(limit) & (limit > 0), limit / np.maximum(np.linalg.norm(q, axis=1), 1e-300), 0)) * (1 - SLACK)
    some = points.filter(F.col("cell").isin(cells[wanted.any(axis=0)].tolist()) & (F.col("length") >= float(least)))
    return some.select("point_id", "vec", "length", "cell").mapInArrow(run, "query_id long, point_id long, score double")


def bounded_search(points: DataFrame, queries: DataFrame, k: int = 10, report: list | None = None, **cells) -> DataFrame:
    """(query_id, rank, point_id, score): as exact_search, by cells."""
    return Cells.build(points, **cells).search(queries, k, report)
