"""Inverted lists with product codes of residuals under a learned rotation.

A point is stored as the number of its nearest centre and, of what is left after the centre, rotated, one byte for each run of entries: the nearest of CODES means of that run. Centres, rotation and means are learned from a bounded sample (SAMPLE points
of least hash of id): means and rotation take turns, the rotation being the orthogonal one that brings the sample nearest to its codes (by singular values). A product is estimated as the query's product with the centre and a sum of table entries; tasks
estimate the points of the lists that a query probes and pass on their n_cand best, which are scored exactly.

With `along` above 1 codes are score-aware: a query that a point is found by lies near the point's own direction, so an error along that direction weighs `along` times as much as one across it. Codes and means then take turns part by part: each point takes the
code of least weighted error given its other parts, and each mean solves the weighted least squares of its points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checked
from ..sources.tables import stored
from .exact import SCORES, best_of, query_blocks, rerank
from .index import best_candidates
from .rotation import vectors_of

SAMPLE, ROUNDS, TURNS = 8192, 8, 6
CODES = 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre at the least distance; of equal ones the first."""
    return ((centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def _means(x: np.ndarray, count: int, seed: int, start: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; a centre that loses its points takes the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), count, replace=len(x) < count)].copy() if start is None else start.copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=count)
        for j in range(x.shape[1]):
            centres[:, j] = np.where(counts > 0, np.bincount(near, x[:, j], count) / np.maximum(counts, 1), centres[:, j])
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = np.argsort(-((x - centres[near]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _error_along(y: np.ndarray, u: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What is missing of each row in the direction u."""
    made = np.hstack([book[codes[:, p]] for p, book in enumerate(books)])
    return ((y - made) * u).sum(axis=1)


def _aware_codes(y: np.ndarray, u: np.ndarray, books: np.ndarray, codes: np.ndarray, along: float) -> np.ndarray:
    """Codes of least weighted error, part by part, the other parts as they are."""
    codes, width = codes.copy(), books.shape[2]
    missing = _error_along(y, u, books, codes)
    for p, book in enumerate(books):
        mine, dirs = y[:, p * width : (p + 1) * width], u[:, p * width : (p + 1) * width]
        told = dirs @ book.T
        others = missing + np.take_along_axis(told, codes[:, p, None], axis=1)[:, 0]
        error = (book * book).sum(axis=1)[None, :] - 2 * (mine @ book.T) + (along - 1) * (others[:, None] - told) ** 2
        codes[:, p] = error.argmin(axis=1)
        missing = others - np.take_along_axis(told, codes[:, p, None], axis=1)[:, 0]
    return codes


def _aware_means(y: np.ndarray, u: np.ndarray, books: np.ndarray, codes: np.ndarray, along: float) -> np.ndarray:
    """Means that solve the weighted least squares of their points, part by part; one without points stays."""
    books, (count, width) = books.copy(), books.shape[1:]
    for p in range(len(books)):
        mine, dirs, of = y[:, p * width : (p + 1) * width], u[:, p * width : (p + 1) * width], codes[:, p]
        others = _error_along(y, u, books, codes) + (dirs * books[p][of]).sum(axis=1)
        left, right = np.zeros((count, width, width)), np.zeros((count, width))
        np.add.at(left, of, np.eye(width) + (along - 1) * dirs[:, :, None] * dirs[:, None, :])
        np.add.at(right, of, mine + (along - 1) * dirs * others[:, None])
        there = np.bincount(of, minlength=count) > 0
        books[p][there] = np.linalg.solve(left[there], right[there][:, :, None])[:, :, 0]
    return books


@dataclass(frozen=True)
class Codebook:
    """centres: lists x dim; rotation: dim x dim, orthogonal; books: parts x CODES x (dim / parts); along: the weight of an error in a point's own direction."""

    centres: np.ndarray
    rotation: np.ndarray
    books: np.ndarray
    along: float = 1.0

    @classmethod
    def learn(cls, points: DataFrame, parts: int = 8, lists: int = 16, codes: int = CODES, seed: int = 42, rotate: bool = True, residual: bool = True, along: float = 1.0) -> Codebook:
        rows = points.select("point_id", F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("point_id"), "point_id").limit(SAMPLE).collect()
        if not rows:
            raise ValueError("no points to learn from")
        x = np.array([r["vec"] for r in rows])
        dim = x.shape[1]
        if dim % parts or not 1 <= codes <= 256 or along < 1:
            raise ValueError("the number of parts must divide the length of the vectors, codes are 1 to 256, and along is not below 1")
        centres = _means(x, lists, seed)
        left = x - centres[_nearest(x, centres)] if residual else x
        rotation, books, width = np.eye(dim), None, dim // parts
        for turn in range(TURNS if rotate else 1):
            y = left @ rotation
            books = np.stack([_means(y[:, p * width : (p + 1) * width], codes, seed + p, None if books is None else books[p], ROUNDS if turn == 0 else 2) for p in range(parts)])
            if rotate and turn < TURNS - 1:
                made = np.hstack([books[p][_nearest(y[:, p * width : (p + 1) * width], books[p])] for p in range(parts)])
                u, _, v = np.linalg.svd(left.T @ made)
                rotation = u @ v
        if along > 1:
            y, u = left @ rotation, _unit(x) @ rotation
            near = np.stack([_nearest(y[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)], axis=1)
            for _ in range(TURNS):
                near = _aware_codes(y, u, books, near, along)
                books = _aware_means(y, u, books, near, along)
        return cls(centres, rotation, books, along)

    def encode(self, x: np.ndarray, residual: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """List numbers and codes (rows x parts)."""
        near = _nearest(x, self.centres)
        y = (x - self.centres[near] if residual else x) @ self.rotation
        width = self.books.shape[2]
        codes = np.stack([_nearest(y[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.books)], axis=1)
        if self.along > 1:
            for _ in range(2):
                codes = _aware_codes(y, _unit(x) @ self.rotation, self.books, codes, self.along)
        return near, codes.astype(np.uint8)


@dataclass
class CodeIndex:
    """table: point_id, list, codes (a byte for each part), in the shared folder, sorted by list. residual: codes are of what is left after the centre, else of the points."""

    points: DataFrame
    book: Codebook
    table: DataFrame
    residual: bool = True

    @classmethod
    def build(cls, points: DataFrame, book: Codebook, residual: bool = True) -> CodeIndex:
        dim = book.centres.shape[1]
        points = checked(points, "vec", dim)
        sent = points.sparkSession.sparkContext.broadcast(book)  # lists, a rotation and the books: of the index's own, fixed size

        def run(batches):
            for b in batches:
                near, codes = sent.value.encode(vectors_of(b.column(1), dim), residual)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary())], names=["point_id", "list", "codes"])

        coded = points.select(F.col("point_id").cast("long").alias("point_id"), "vec").mapInArrow(run, "point_id long, list int, codes binary")
        # by id inside a list too, so a large list is many tasks
        return cls(points, book, stored(coded.repartitionByRange("list", "point_id").sortWithinPartitions("list", "point_id")), residual)

    def estimates(self, queries: DataFrame, n_probes: int, n_cand: int) -> DataFrame:
        """(query_id, point_id, est, rank): the n_cand best estimates among the lists whose centres have the largest products with the query."""
        queries = checked(queries, "vec", self.book.centres.shape[1])
        found = None
        for part in query_blocks(queries, queries.count() * (self.book.books.shape[0] * self.book.books.shape[1] + 2 * n_cand)):
            some = self._block(part, n_probes, n_cand)
            found = some if found is None else found.unionByName(some)
        return best_candidates(found, n_cand)

    def _block(self, queries: DataFrame, n_probes: int, n_cand: int) -> DataFrame:
        rows = queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).collect()  # QUERY_BYTES at most
        names, book = np.array([r["query_id"] for r in rows], dtype=np.int64), self.book
        q = np.array([r["vec"] for r in rows], dtype=float).reshape(len(rows), book.centres.shape[1])
        coarse = q @ book.centres.T
        probed = np.zeros(coarse.shape, dtype=bool)
        np.put_along_axis(probed, np.argsort(-coarse, axis=1, kind="stable")[:, :n_probes], True, axis=1)
        turned, width = q @ book.rotation, book.books.shape[2]
        tables = np.stack([turned[:, p * width : (p + 1) * width] @ b.T for p, b in enumerate(book.books)], axis=1)
        sent = queries.sparkSession.sparkContext.broadcast((names, coarse if self.residual else np.zeros_like(coarse), probed, tables))
        parts = len(book.books)

        def run(batches):
            names, coarse, probed, tables = sent.value
            best = np.full((len(names), n_cand), -np.inf), np.full((len(names), n_cand), np.iinfo(np.int64).max)
            for b in batches:
                if not b.num_rows or not len(names):
                    continue
                ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), parts)
                for one in np.unique(lists):
                    here, asking = np.flatnonzero(lists == one), np.flatnonzero(probed[:, one])
                    step = max(1, SCORES // (len(here) + n_cand))
                    for at in range(0, len(asking), step):
                        some = asking[at : at + step]
                        est = np.repeat(coarse[some, one][:, None], len(here), axis=1)
                        for p in range(parts):
                            est += tables[some[:, None], p, codes[here, p][None, :]]
                        both = np.hstack([best[0][some], est]), np.hstack([best[1][some], np.broadcast_to(ids[here], est.shape)])
                        _, e, i = best_of(*both, n_cand)
                        best[0][some], best[1][some] = e.reshape(-1, n_cand), i.reshape(-1, n_cand)
            there = best[1] < np.iinfo(np.int64).max
            row = np.nonzero(there)[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[row] if len(names) else [], pa.int64()), pa.array(best[1][there], pa.int64()), pa.array(best[0][there], pa.float64())], names=["query_id", "point_id", "est"])

        return self.table.mapInArrow(run, "query_id long, point_id long, est double")

    def search(self, queries: DataFrame, k: int = 10, n_probes: int = 4, n_cand: int = 100) -> DataFrame:
        """(query_id, rank, point_id, score)"""
        return rerank(self.estimates(queries, n_probes, n_cand), self.points, queries, k)
