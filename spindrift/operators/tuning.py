"""Parameters of a bucket search by measurement, and an exact way for queries that a bound does not settle.

`calibrate` takes SAMPLE queries (of least hash of id), finds their exact neighbours in one pass, and in one more pass for each number of repeats counts at which place of each probed bucket the neighbours would stand: as many points
as have no smaller value there. So the recall of every number of probes and every bucket size is known without building an index, and the cheapest pair that reaches the target is taken. A bucket has at most ROOT times the root of the number of points,
so what a query reads grows with that root, whatever comes out; where no pair reaches the target the best one is taken and `met` is false.

`certain_search` bounds what a bucket search has not read. In one rotation a query q and a point x of no read bucket have q x = the sum over directions of their projections' products over w^3 (w: the width); on probed directions x is at most the last value that was read,
on all others the Cauchy-Schwarz inequality holds, with the greatest length of a point. Queries whose k-th score is not above the least of these bounds go to the exact search by cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checked, norm2
from ..plans import IndexConfig, QueryConfig
from ..sources.tables import stored
from .bounded import Cells
from .exact import exact_search
from .index import MipsIndex, bucket_estimates
from .rotation import project, project_batch, vectors_of
from .topk import probes

SAMPLE = 64
REPEATS = (2, 8, 32)
PROBES = (8, 12, 16, 24, 32, 48)
ROOT = 12
#: What the sample has to reach beyond the target, as it is a sample.
MARGIN = 0.02
#: Projections that a task holds at a time.
HELD = 1 << 21


@dataclass(frozen=True)
class Calibration:
    """cfg and q as they go into MipsIndex; recall: of the sample; entries: read by a query; met: whether the target was reached."""

    cfg: IndexConfig
    q: QueryConfig
    recall: float
    entries: int
    met: bool


def _places(points: DataFrame, cfg: IndexConfig, dirs: np.ndarray, sgns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each (dir, sgn, value), the points whose signed projection is not below the value."""
    order = np.lexsort((values, sgns, dirs))
    dirs, sgns, values = dirs[order], sgns[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(dirs) != 0) | (np.diff(sgns) != 0)]))
    sent = points.sparkSession.sparkContext.broadcast((dirs, sgns, values, begin))  # SAMPLE times k times the greatest number of probes

    def run(batches):
        dirs, sgns, values, begin = sent.value
        ends, counts = np.append(begin[1:], len(values)), np.zeros(len(values), dtype=np.int64)
        step = max(1, HELD // cfg.directions)
        for b in batches:
            x = vectors_of(b.column(0), cfg.dim)
            for at in range(0, len(x), step):
                some = project_batch(x[at : at + step], cfg)
                for lo, hi in zip(begin, ends):
                    mine = np.sort(some[:, dirs[lo]] * sgns[lo])
                    counts[lo:hi] += len(mine) - np.searchsorted(mine, values[lo:hi], side="left")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["i", "n"])

    got = points.select("vec").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(values), dtype=np.int64)
    for r in got:
        out[order[r["i"]]] = r["n"]
    return out


def calibrate(points: DataFrame, queries: DataFrame, dim: int, k: int = 10, target: float = 0.9, kind: str = "hash", repeats: tuple[int, ...] = REPEATS, n_proj: int | None = None, probed: tuple[int, ...] = PROBES, sample: int = SAMPLE, root: float = ROOT) -> Calibration:
    """kind hash: all points of the read buckets are scored; kind bucket: also how many of the best estimates have to be, at most `root` times the root of the points."""
    if kind not in ("hash", "bucket"):
        raise ValueError("kind must be hash or bucket")
    n = points.count()
    most = max(k, math.ceil(root * math.sqrt(n)))
    some = stored(queries.select("query_id", "vec").orderBy(F.xxhash64("query_id"), "query_id").limit(sample))
    truth = stored(exact_search(points, some, k))
    vectors = {r["point_id"]: r["vec"] for r in truth.select("point_id").distinct().join(points, "point_id").collect()}  # SAMPLE times k at most
    asked = {r["query_id"]: r["vec"] for r in some.collect()}
    pairs = truth.select("query_id", "point_id").collect()
    # of what the buckets have, the best estimates are only a part
    reach = min(1.0, target + MARGIN) if kind == "hash" else 1 - (1 - target) / 5
    base, best = IndexConfig(dim, n_proj or dim, 1, most), None
    if not pairs:
        return Calibration(base, QueryConfig(k, 1, None, most), 1.0, 0, True)
    names = sorted(asked)
    row = {q: i for i, q in enumerate(names)}
    of, near = np.array([row[p["query_id"]] for p in pairs]), np.array([vectors[p["point_id"]] for p in pairs], dtype=float)
    for r in repeats:
        cfg = replace(base, n_repeats=r)
        width = min(max(probed), cfg.directions)
        mine = project_batch(np.array([asked[q] for q in names], dtype=float), cfg)
        dirs = np.argsort(-np.abs(mine), axis=1, kind="stable")[:, :width]
        sgns = np.where(np.take_along_axis(mine, dirs, axis=1) < 0, -1, 1)
        values = np.take_along_axis(project_batch(near, cfg), dirs[of], axis=1) * sgns[of]
        place = _places(points, cfg, dirs[of].ravel(), sgns[of].ravel(), values.ravel()).reshape(values.shape)
        first = np.minimum.accumulate(place, axis=1)
        for s in probed:
            if s > width:
                continue
            needed = np.sort(first[:, s - 1])
            m = int(min(most, max(k, needed[min(len(needed) - 1, math.ceil(reach * len(needed)) - 1)])))
            recall = float((needed <= m).mean())
            got = Calibration(replace(cfg, top_m=m), QueryConfig(k, s, None, most), recall, s * m, recall >= min(reach, 1.0))
            if best is None or (got.met, -got.entries if got.met else got.recall) > (best.met, -best.entries if best.met else best.recall):
                best = got
    if kind == "bucket":
        index = MipsIndex.build(points, best.cfg, "bucket")
        est = bucket_estimates(index.table, index.probe(some, best.q), best.cfg.top_m)
        ahead = est.withColumnRenamed("est", "other").join(truth.join(est, ["query_id", "point_id"]).select("query_id", F.col("point_id").alias("near"), "est"), "query_id").filter("other >= est")
        placed = sorted(r["n"] for r in ahead.groupBy("query_id", "near").agg(F.count("*").alias("n")).collect())
        at = math.ceil(min(1.0, target + MARGIN) * len(pairs)) - 1
        cand = int(min(most, placed[at])) if at < len(placed) else most
        recall = sum(x <= cand for x in placed) / len(pairs)
        best = replace(best, q=replace(best.q, n_cand=max(k, cand)), recall=recall, met=recall >= target)
    return best


def calibrated_search(points: DataFrame, queries: DataFrame, dim: int, k: int = 10, target: float = 0.9, kind: str = "hash", report: list | None = None, **options) -> DataFrame:
    """(query_id, rank, point_id, score) with parameters that reach the target on a sample. report: gets the Calibration."""
    got = calibrate(points, queries, dim, k, target, kind, **options)
    if report is not None:
        report.append(got)
    return MipsIndex.build(points, got.cfg, kind).search(queries, got.q)


def unread_bounds(index: MipsIndex, queries: DataFrame, q: QueryConfig) -> DataFrame:
    """(query_id, bound): no point outside the read parts of the probed buckets has a greater inner product with the query."""
    cfg = index.cfg
    if cfg.centering:
        raise ValueError("bounds are for projections of the points themselves")
    longest = math.sqrt(index.points.agg(F.max(norm2(F.col("vec"))).alias("x")).first()["x"] or 0.0)
    scale = float(cfg.width) ** 1.5
    ends = index.table.filter(F.col("rk") == q.prefix(cfg)).select("dir", "sgn", F.col("val").alias("last"))
    probed = index.probe(queries, q).join(ends, ["dir", "sgn"], "left").withColumn("turn", F.expr(f"cast(dir div {cfg.n_proj} as int)"))
    # a bucket that is shorter than what is read holds all points, so nothing is left unread
    whole = F.max(F.col("last").isNull().cast("int"))
    sums = probed.groupBy("query_id", "turn").agg(F.sum(F.col("mag") * F.col("last")).alias("told"), F.sum(F.col("mag") * F.col("mag")).alias("mags"), whole.alias("whole"))
    length = queries.select("query_id", (F.sqrt(norm2(F.col("vec"))) * scale).alias("length"))
    rest = F.sqrt(F.greatest(F.col("length") * F.col("length") - F.col("mags"), F.lit(0.0)))
    bound = F.when(F.col("whole") == 1, F.lit(float("-inf"))).otherwise((F.col("told") + rest * (longest * scale)) / (scale * scale))
    return sums.join(length, "query_id").groupBy("query_id").agg(F.min(bound).alias("bound"))


def certain_search(index: MipsIndex, queries: DataFrame, q: QueryConfig, report: list | None = None) -> DataFrame:
    """(query_id, rank, point_id, score): the rows of exact_search. index: of kind bucket; report: gets (queries, those that the bound settled)."""
    if index.kind != "bucket":
        raise ValueError("kind must be bucket")
    queries = checked(queries, "vec", index.cfg.dim)
    found = stored(replace(index, kind="hash").search(queries, q))
    last = found.filter(F.col("rank") == q.k).select("query_id", "score")
    # rounded sums: scores must be above the bound by a little
    sure = F.col("score") > F.col("bound") + F.lit(1e-9) * F.abs("bound") + 1e-9
    settled = stored(queries.select("query_id").join(last, "query_id", "left").join(unread_bounds(index, queries, q), "query_id").select("query_id", F.coalesce(F.col("bound") == float("-inf"), F.lit(False)).alias("all"), F.coalesce(sure, F.lit(False)).alias("sure")))
    done = settled.filter("sure or all").select("query_id")
    open_ = queries.join(settled.filter("not (sure or all)").select("query_id"), "query_id", "left_semi")
    if report is not None:
        report.append((settled.count(), done.count()))
    exact = Cells.build(index.points, index.cfg.dim).search(open_, q.k)
    return found.join(done, "query_id", "left_semi").unionByName(exact)
