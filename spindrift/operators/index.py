"""Indexes on random projections and their searches.

An index is a DataFrame. Dense: (point_id, proj). Buckets: (dir, sgn, rk, point_id, val), for each direction and sign the top_m
points with the largest sgn * projection; groups have equal sizes, so exchanges on (dir, sgn) are even by construction.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import center, checked, mean_vector
from ..plans import IndexConfig, QueryConfig
from . import shares
from .exact import SCORES, best_of, query_blocks, rerank
from .rotation import long_projection, project, project_batch, vectors_of
from .topk import probes, ranked, top_per_group

#: Projections that a task makes at a time.
HELD = 1 << 21
#: Buckets of up to so many bytes are sent to all tasks in a search.
INDEX_BYTES = 64 << 20
BUCKET = "dir int, sgn int, point_id long, val double"


def _local_buckets(cfg: IndexConfig, only: list[tuple[int, int]] | None = None):
    """Each task's own top_m per direction and sign (of those in `only`, if given): what crosses the shuffle doesn't grow with its points."""
    chosen = None if only is None else np.array([d + cfg.directions * (s < 0) for d, s in only], dtype=int)

    def run(batches):
        every = np.arange(2 * cfg.directions) if chosen is None else chosen
        sides = len(every)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        best = np.zeros((sides, 0)), np.zeros((sides, 0), dtype=np.int64)

        def fold():
            nonlocal best, held
            ids, rows = np.concatenate([i for i, _ in held]), np.vstack([r for _, r in held]).T
            held = []
            width = min(cfg.top_m, best[0].shape[1] + len(ids))
            values, points = np.empty((sides, width)), np.empty((sides, width), dtype=np.int64)
            step = max(1, SCORES // (len(ids) + cfg.top_m))
            for at in range(0, sides, step):
                some = np.arange(at, min(sides, at + step))
                side = every[some]
                new = rows[side % cfg.directions] * np.where(side < cfg.directions, 1.0, -1.0)[:, None]
                both = np.hstack([best[0][some], new]), np.hstack([best[1][some], np.broadcast_to(ids, new.shape)])
                _, v, p = best_of(*both, cfg.top_m)
                values[some], points[some] = v.reshape(-1, width), p.reshape(-1, width)
            best = values, points

        def told():
            width = best[0].shape[1]
            for at in range(0, sides, max(1, SCORES // max(1, width))):
                some = np.arange(at, min(sides, at + max(1, SCORES // max(1, width))))
                side = np.repeat(every[some], width)
                cols = (side % cfg.directions, pa.int32()), (np.where(side < cfg.directions, 1, -1), pa.int32()), (best[1][some].ravel(), pa.int64()), (best[0][some].ravel(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["dir", "sgn", "point_id", "val"])

        large = sides * cfg.top_m > 2 * HELD  # what a task would hold for such buckets grows with them, so it passes on what it has
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False), vectors_of(b.column(1), cfg.dim)
            step = max(1, HELD // cfg.directions)
            for at in range(0, len(ids), step):
                held.append((ids[at : at + step], project_batch(x[at : at + step], cfg)))
                if sum(len(i) for i, _ in held) * cfg.directions > (HELD if large else max(2 * HELD, cfg.top_m * cfg.directions)):
                    fold()
                    if large:
                        yield from told()
                        best = np.zeros((sides, 0)), np.zeros((sides, 0), dtype=np.int64)
        if held:
            fold()
        yield from told()

    return run


def ranked_buckets(entries: DataFrame, top_m: int) -> DataFrame:
    top = top_per_group(entries, ["dir", "sgn"], [F.desc("val"), F.col("point_id")], top_m, "rk")
    return top.select("dir", "sgn", "rk", "point_id", "val")


def signed_entries(projected: DataFrame) -> DataFrame:
    """(dir, sgn, point_id, sgn * val) for both signs."""
    sides = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sgn")
    long = long_projection(projected, "point_id").select("dir", "point_id", "val", sides)
    return long.select("dir", "sgn", "point_id", (F.col("sgn") * F.col("val")).alias("val"))


def build_buckets(points: DataFrame, cfg: IndexConfig, backend: str = "arrow", only: list[tuple[int, int]] | None = None) -> DataFrame:
    if backend == "sql":
        return ranked_buckets(signed_entries(project(points, cfg, backend="sql")), cfg.top_m)
    typed = points.select(F.col("point_id").cast("long").alias("point_id"), "vec")
    return ranked_buckets(typed.mapInArrow(_local_buckets(cfg, only), BUCKET), cfg.top_m)


def _steps(probed: DataFrame) -> DataFrame:
    """(query_id, steps): a query's probes in order."""
    return probed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rk", "dir", "sgn"))).alias("steps"))


def _steps_of(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[p["dir"] for p in r["steps"]] for r in rows], dtype=int), np.array([[p["sgn"] for p in r["steps"]] for r in rows], dtype=float)


def dense_search(index: DataFrame, probed: DataFrame, n_cand: int, points: DataFrame, queries: DataFrame, k: int, directions: int) -> DataFrame:
    """(query_id, rank, point_id, score): rerank(dense_best(...)), without a pair held or shuffled but those near the n_cand-th."""
    asked = queries.select("query_id", "vec").join(_steps(probed), "query_id")
    return shares.search(points.join(index, "point_id"), ["proj"], asked, _steps_of, shares.by_directions, 2 * directions, k, n_cand, index)


def hash_searched(buckets: DataFrame, probed: DataFrame, prefix: int, points: DataFrame, queries: DataFrame, k: int, directions: int) -> DataFrame:
    """(query_id, rank, point_id, score): rerank(hash_candidates(...)) for buckets of any size. A point carries a bit for each bucket that holds it, a query one for each that it probes, and pairs with a common bit are scored where the points lie."""
    side = F.col("dir").cast("long") * 2 + (F.col("sgn") < 0).cast("long")
    words = -(-2 * directions // 64)
    bits = [F.expr(f"bit_or(if(side div 64 = {w}, shiftleft(1L, cast(side % 64 as int)), 0L))").alias(f"w{w}") for w in range(words)]
    held = buckets.filter(F.col("rk") <= prefix).select("point_id", side.alias("side")).groupBy("point_id").agg(*bits)

    def asked(rows) -> tuple:
        out = np.zeros((len(rows), 64 * words), dtype=np.uint8)
        for i, r in enumerate(rows):
            out[i, r["sides"]] = 1
        return (np.packbits(out, axis=1, bitorder="little").view("<i8"),)

    names = [f"w{w}" for w in range(words)]
    return shares.search(points.join(held, "point_id"), names, queries.select("query_id", "vec").join(_sides(probed), "query_id"), asked, shares.by_sides, words, k)


def dense_estimates(index: DataFrame, probed: DataFrame) -> DataFrame:
    """(query_id, point_id, est): the signed sum of a point's projections on the probed directions."""
    # a row for every pair is what is asked for here; searches don't make them
    return shares.all_pairs(index, ["proj"], _steps(probed), _steps_of, shares.by_directions, 2 * (probed.agg(F.max("rk")).first()[0] or 0), "est")


def dense_best(index: DataFrame, probed: DataFrame, n_cand: int) -> DataFrame:
    """(query_id, point_id, est, rank) of the n_cand best estimates of each query: tasks estimate batches of points for blocks of queries and pass on only their own best."""
    steps = F.sort_array(F.collect_list(F.struct("rk", "dir", "sgn"))).alias("steps")
    per_query = probed.groupBy("query_id").agg(steps)
    queries = per_query.count()
    found = None
    for part in query_blocks(per_query, probed.count() * 2 + queries * n_cand * 2):  # and what a task holds for them
        some = _estimated_in_tasks(index, part, n_cand)
        found = some if found is None else found.unionByName(some)
    return best_candidates(found, n_cand)


def _estimated_in_tasks(index: DataFrame, per_query: DataFrame, n_cand: int) -> DataFrame:
    rows = per_query.select("query_id", F.col("steps.dir").alias("dir"), F.col("steps.sgn").alias("sgn")).collect()
    sent = index.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows]), np.array([r["dir"] for r in rows], dtype=int), np.array([r["sgn"] for r in rows], dtype=float)))

    def run(batches):
        names, dirs, signs = sent.value
        best = np.full((len(names), n_cand), -np.inf), np.full((len(names), n_cand), np.iinfo(np.int64).max)
        for b in batches:
            if not len(names) or not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            proj = np.ascontiguousarray(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).T)
            step = max(1, SCORES // (len(ids) + n_cand))
            for at in range(0, len(names), step):
                some = slice(at, at + step)
                est = np.zeros((len(names[some]), len(ids)))
                for j in range(dirs.shape[1]):  # in order of the probes
                    est += signs[some, j, None] * proj[dirs[some, j]]
                both = np.hstack([best[0][some], est]), np.hstack([best[1][some], np.broadcast_to(ids, est.shape)])
                _, e, point = best_of(*both, n_cand)
                best[0][some], best[1][some] = e.reshape(-1, n_cand), point.reshape(-1, n_cand)
        there = best[1] < np.iinfo(np.int64).max
        rows = np.nonzero(there)[0]
        yield pa.RecordBatch.from_arrays([pa.array(names[rows] if len(names) else [], pa.int64()), pa.array(best[1][there], pa.int64()), pa.array(best[0][there], pa.float64())], names=["query_id", "point_id", "est"])

    return index.select(F.col("point_id").cast("long").alias("point_id"), "proj").mapInArrow(run, "query_id long, point_id long, est double")


def probed_entries(buckets: DataFrame, probed: DataFrame, prefix: int) -> DataFrame:
    return probed.join(buckets.filter(F.col("rk") <= prefix).drop("rk"), ["dir", "sgn"])


def bucket_estimates(buckets: DataFrame, probed: DataFrame, prefix: int, estimator: str = "sum") -> DataFrame:
    value = F.avg("val") if estimator == "mean" else F.sum("val")
    return probed_entries(buckets, probed, prefix).groupBy("query_id", "point_id").agg(value.alias("est"))


def hash_candidates(buckets: DataFrame, probed: DataFrame, prefix: int) -> DataFrame:
    return probed_entries(buckets, probed, prefix).select("query_id", "point_id").distinct()


def _sent(buckets: DataFrame, prefix: int):
    """The read parts of all buckets as a broadcast: bucket numbers (2 dir, and 1 for the far side) in order, ids, values."""
    got = buckets.filter(F.col("rk") <= prefix).select("dir", "sgn", "rk", "point_id", *(["val"] if "val" in buckets.columns else [])).toArrow()  # INDEX_BYTES at most
    dirs, sgns, rks, ids = (got.column(c).to_numpy() for c in ("dir", "sgn", "rk", "point_id"))
    side = 2 * dirs.astype(np.int64) + (sgns < 0)
    order = np.lexsort((rks, side))
    vals = got.column("val").to_numpy()[order] if "val" in got.column_names else np.zeros(len(ids))
    return buckets.sparkSession.sparkContext.broadcast((side[order], ids[order], vals))


def _sides(probed: DataFrame) -> DataFrame:
    """(query_id, sides): the numbers of a query's probed buckets, in order of the probes."""
    steps = F.sort_array(F.collect_list(F.struct("rk", "dir", "sgn"))).alias("steps")
    return probed.groupBy("query_id").agg(steps).select("query_id", F.transform("steps", lambda p: p["dir"].cast("long") * 2 + (p["sgn"] < 0).cast("long")).alias("sides"))


def _entries_at(side: np.ndarray, sides) -> np.ndarray:
    """Places of the entries of buckets."""
    begin, end = np.searchsorted(side, sides, "left"), np.searchsorted(side, sides, "right")
    return np.concatenate([np.arange(x, y) for x, y in zip(begin, end)] or [np.zeros(0, dtype=int)])


def _by_query(buckets: DataFrame, probed: DataFrame, prefix: int, schema: str, pick) -> DataFrame:
    """pick(point ids, values) of each query's probed buckets, query by query in tasks, to all of which the buckets are sent."""
    spark, sent = buckets.sparkSession, _sent(buckets, prefix)

    def run(batches):
        side, ids, vals = sent.value
        names, kinds = zip(*(f.split() for f in schema.split(", ")))
        kinds = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[k] for k in kinds]
        for b in batches:
            for query, sides in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = _entries_at(side, sides)
                cols = pick(ids[at], vals[at])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((np.full(len(cols[0]), query), *cols), kinds)], names=list(names))

    return _sides(probed).repartition(spark.sparkContext.defaultParallelism, "query_id").mapInArrow(run, schema)


def sent_whole(cfg: IndexConfig, prefix: int) -> bool:
    """Whether the read parts of all buckets fit in INDEX_BYTES."""
    return 2 * cfg.directions * prefix * 24 <= INDEX_BYTES


def bucket_best(buckets: DataFrame, probed: DataFrame, prefix: int, n_cand: int, estimator: str, cfg: IndexConfig) -> DataFrame:
    """The rows of best_candidates(bucket_estimates(...), n_cand). Buckets of up to INDEX_BYTES go to all tasks, which estimate query by query, so nothing is shuffled for a query and a point; larger ones are joined."""
    if not sent_whole(cfg, prefix):
        return best_candidates(bucket_estimates(buckets, probed, prefix, estimator), n_cand)

    def pick(ids, vals):
        points, of = np.unique(ids, return_inverse=True)
        est = np.bincount(of, vals, len(points))
        if estimator == "mean":
            est /= np.bincount(of, minlength=len(points))
        best = np.lexsort((points, -est))[:n_cand]
        return points[best], est[best], np.arange(1, len(best) + 1, dtype=np.int32)

    return _by_query(buckets, probed, prefix, "query_id long, point_id long, est double, rank int", pick)


def hash_union(buckets: DataFrame, probed: DataFrame, prefix: int, cfg: IndexConfig) -> DataFrame:
    """The rows of hash_candidates, in the same two ways."""
    if not sent_whole(cfg, prefix):
        return hash_candidates(buckets, probed, prefix)
    return _by_query(buckets, probed, prefix, "query_id long, point_id long", lambda ids, vals: (np.unique(ids),))


def hash_scored(buckets: DataFrame, probed: DataFrame, prefix: int, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, point_id, score): rerank(hash_candidates(...)) for buckets that are sent whole. Tasks score the points that a query's buckets hold where the points lie, and pass on their k best; no pair of a query and a point is shuffled."""
    sent, found = _sent(buckets, prefix), None
    spark = points.sparkSession
    for part in query_blocks(queries, queries.agg(F.sum(F.size("vec")).alias("n")).first()["n"] or 0):
        rows = part.select("query_id", F.col("vec").cast("array<double>").alias("vec")).join(_sides(probed), "query_id").collect()  # QUERY_BYTES
        asked = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["vec"] for r in rows], dtype=float), [r["sides"] for r in rows]))
        some = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_hash_scorer(sent, asked, k), "query_id long, point_id long, score double")
        found = some if found is None else found.unionByName(some)
    return ranked(found, k)


def _hash_scorer(sent, asked, k: int):
    def run(batches):
        side, ids, _ = sent.value
        names, q, sides = asked.value
        best = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
        held: list = []

        def scored():
            points, x = np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held])
            order = np.argsort(points, kind="stable")
            points, x = points[order], x[order]
            # the entries of all buckets that are points of this task
            here = np.searchsorted(points, ids)
            mine = np.flatnonzero(points[np.minimum(here, len(points) - 1)] == ids)
            place, own = here[mine], side[mine]
            for i, buckets in enumerate(sides):
                some = np.unique(place[_entries_at(own, buckets)])
                score = np.zeros(len(some))
                for j in range(q.shape[1]):  # in order of position, so that every formulation adds up alike
                    score += q[i, j] * x[some, j]
                _, s, p = best_of(np.append(best[0][i], score)[None], np.append(best[1][i], points[some])[None], k)
                best[0][i], best[1][i] = s, p

        for b in batches:
            if b.num_rows and len(names):
                p = b.column(0).to_numpy(zero_copy_only=False)
                held.append((p, b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(p), -1)))
                if sum(len(h[0]) for h in held) * q.shape[1] > 2 * HELD:
                    scored()
                    held = []
        if held:
            scored()
        there = best[1] < np.iinfo(np.int64).max
        rows = np.nonzero(there)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.int64)[rows], pa.int64()), pa.array(best[1][there], pa.int64()), pa.array(best[0][there], pa.float64())], names=["query_id", "point_id", "score"])

    return run


def best_candidates(estimates: DataFrame, n_cand: int) -> DataFrame:
    return top_per_group(estimates, ["query_id"], [F.desc("est"), F.col("point_id")], n_cand)


@dataclass
class MipsIndex:
    """kind: dense, bucket (valued buckets) or hash (ids only). Exact scores are on the original vectors."""

    points: DataFrame
    cfg: IndexConfig
    kind: str
    table: DataFrame

    @classmethod
    def build(cls, points: DataFrame, cfg: IndexConfig, kind: str = "bucket") -> MipsIndex:
        points = checked(points, "vec", cfg.dim)
        used = center(points, mean_vector(points)) if cfg.centering else points
        if kind == "dense":
            return cls(points, cfg, kind, project(used, cfg))
        if kind not in ("bucket", "hash"):
            raise ValueError("kind must be dense, bucket or hash")
        table = build_buckets(used, cfg)
        return cls(points, cfg, kind, table.drop("val") if kind == "hash" else table)

    def probe(self, queries: DataFrame, q: QueryConfig) -> DataFrame:
        q.check(self.cfg)
        projected = project(checked(queries, "vec", self.cfg.dim), self.cfg, "query_id")
        return probes(projected, q.n_probed_vectors)

    def candidates(self, queries: DataFrame, q: QueryConfig) -> DataFrame:
        probed, prefix = self.probe(queries, q), q.prefix(self.cfg)
        if self.kind == "dense":
            return dense_best(self.table, probed, q.n_cand)
        if self.kind == "bucket":
            return bucket_best(self.table, probed, prefix, q.n_cand, q.estimator, self.cfg)
        return hash_union(self.table, probed, prefix, self.cfg)

    def search(self, queries: DataFrame, q: QueryConfig) -> DataFrame:
        """(query_id, rank, point_id, score)"""
        if self.kind == "hash" and sent_whole(self.cfg, q.prefix(self.cfg)):
            return hash_scored(self.table, self.probe(queries, q), q.prefix(self.cfg), self.points, queries, q.k)
        if self.kind == "hash":
            return hash_searched(self.table, self.probe(queries, q), q.prefix(self.cfg), self.points, queries, q.k, self.cfg.directions)
        if self.kind == "dense":
            return dense_search(self.table, self.probe(queries, q), q.n_cand, self.points, queries, q.k, self.cfg.directions)
        return rerank(self.candidates(queries, q), self.points, queries, q.k)

    def cache(self) -> MipsIndex:
        return replace(self, table=self.table.cache())

    def clear(self) -> None:
        self.table.unpersist()

    def save(self, path: str) -> None:
        """The table as Parquet, clustered by direction, with the parameters beside it."""
        table = self.table if self.kind == "dense" else self.table.repartition("dir").sortWithinPartitions("dir", "sgn", "rk")
        table.write.parquet(f"{path}/table")
        c = self.cfg
        meta = [(self.kind, c.dim, c.n_proj, c.n_repeats, c.top_m, c.sign_seed, c.centering)]
        self.table.sparkSession.createDataFrame(meta, "kind string, dim int, n_proj int, n_repeats int, top_m int, seed int, centering boolean").write.parquet(f"{path}/params")

    @classmethod
    def load(cls, points: DataFrame, path: str) -> MipsIndex:
        spark = points.sparkSession
        meta = spark.read.parquet(f"{path}/params").first().asDict()
        return cls(points, kind=meta.pop("kind"), cfg=IndexConfig(**meta), table=spark.read.parquet(f"{path}/table"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of a query's k true neighbours that were found; order and scores don't count."""
    hits = truth.filter(F.col("rank") <= k).join(found.filter(F.col("rank") <= k), ["query_id", "point_id"], "left_semi")
    n = truth.select("query_id").distinct().agg(F.count("*").alias("n"))
    return hits.agg(F.count("*").alias("h")).crossJoin(n).select((F.col("h") / (F.col("n") * k)).alias("recall"))


def candidate_counts(candidates: DataFrame) -> DataFrame:
    per = candidates.groupBy("query_id").agg(F.countDistinct("point_id").alias("n"))
    return per.agg(F.avg("n").alias("avg_candidates"), F.count("*").alias("n_queries"))


def size_report(points: DataFrame, cfg: IndexConfig) -> DataFrame:
    """Bytes of the vectors and of each index kind at four bytes a number."""
    n = points.agg(F.count("*").alias("n_points"))
    x, d, m = F.col("n_points") * cfg.dim * 4, cfg.directions, cfg.top_m
    return n.select("n_points", x.alias("vector_bytes"), (x + F.col("n_points") * d * 4).alias("dense_bytes"), (x + 4 * m * d * 4).cast("long").alias("bucket_bytes"), (x + 2 * m * d * 4).cast("long").alias("hash_bytes"))
