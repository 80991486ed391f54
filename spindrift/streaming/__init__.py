"""A bucket index over a sliding window of points, as batch updates and as a Structured Streaming sink.

Age is the column `seq`, increasing; the oldest points leave first. A position in the window is seq minus the oldest seq
while numbers are gapless, so nothing is renumbered. mode="incremental" lets survivors of the old buckets and the new points compete (a survivor that
was outside its bucket can't return); mode="rebuild" recomputes the buckets of the whole window; `reserve.ReserveWindow` keeps more than a bucket shows, so that none is lost and few are recomputed.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import center, checked, mean_vector
from ..operators.exact import rerank
from ..operators.index import bucket_best, build_buckets, hash_scored, hash_searched, ranked_buckets, sent_whole
from ..operators.rotation import project
from ..operators.topk import probes
from ..plans import IndexConfig, QueryConfig
from ..sources.tables import drop_path, fresh_path, id_at, names_in, stored


#: Tables of live points beyond which they are written as one.
PARTS = 16


@dataclass
class WindowIndex:
    """points: seq, vec of the window; buckets: dir, sgn, rk, point_id (a seq), val; mean is fixed at the build."""

    points: DataFrame
    buckets: DataFrame
    cfg: IndexConfig
    mean: tuple[float, ...] | None = None

    @classmethod
    def build(cls, points: DataFrame, cfg: IndexConfig) -> WindowIndex:
        points = checked(points.select("seq", "vec"), "vec", cfg.dim)
        mean = tuple(mean_vector(points)) if cfg.centering else None
        return cls(points, _buckets(points, cfg, mean), cfg, mean)

    def update(self, new: DataFrame | None, n_del: int = 0, mode: str = "incremental") -> WindowIndex:
        """Append new points, then drop the n_del oldest of all."""
        if mode not in ("incremental", "rebuild"):
            raise ValueError("mode must be incremental or rebuild")
        points, added, first = self.slid(new, n_del)
        if mode == "rebuild":
            return replace(self, points=points, buckets=_buckets(points, self.cfg, self.mean))
        survivors = self.buckets.drop("rk")
        if first is not None:
            survivors = survivors.filter(F.col("point_id") >= first)
        entries = survivors.unionByName(_buckets(added, self.cfg, self.mean).drop("rk"))
        return replace(self, points=points, buckets=ranked_buckets(entries, self.cfg.top_m))

    def slid(self, new: DataFrame | None, n_del: int) -> tuple[DataFrame, DataFrame, int | None]:
        """The points of the window after an update, those that are new, and the oldest seq that stays (None if none leaves)."""
        old = self.points.agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
        if n_del < 0 or n_del > old["n"]:
            raise ValueError("more points are to leave than the window has")
        added = self.points.limit(0) if new is None else checked(new.select("seq", "vec"), "vec", self.cfg.dim)
        got = added.agg(F.count("*").alias("n"), F.min("seq").alias("lo")).first()
        if got["n"] and old["n"] and got["lo"] <= old["hi"]:
            raise ValueError("new points must have larger seq than the window's")
        if old["n"] + got["n"] - n_del < self.cfg.top_m:
            raise ValueError("the window would be smaller than a bucket")
        points, first = self.points.unionByName(added), None
        if n_del:
            if old["hi"] - old["lo"] + 1 == old["n"]:
                first = old["lo"] + n_del
            else:
                first = id_at(self.points, "seq", n_del) if n_del < old["n"] else old["hi"] + 1
            points = points.filter(F.col("seq") >= first)
        return points, added, first

    def delete(self, ids: DataFrame, mode: str = "incremental") -> WindowIndex:
        """Without the points whose seq is in ids (seq), of any age; buckets keep what else they hold, or are made again with mode="rebuild"."""
        points = self.points.join(ids.select("seq"), "seq", "left_anti")
        if mode == "rebuild":
            return replace(self, points=points, buckets=_buckets(points, self.cfg, self.mean))
        gone = ids.select(F.col("seq").alias("point_id"))
        return replace(self, points=points, buckets=ranked_buckets(self.buckets.drop("rk").join(gone, "point_id", "left_anti"), self.cfg.top_m))

    def replaced(self, points: DataFrame) -> WindowIndex:
        """A full turnover: the window holds only these points; the mean stays."""
        points = checked(points.select("seq", "vec"), "vec", self.cfg.dim)
        return replace(self, points=points, buckets=_buckets(points, self.cfg, self.mean))

    def settled(self) -> WindowIndex:
        """With points and buckets as tables in the shared folder, so that many updates keep a short lineage."""
        return replace(self, points=stored(self.points), buckets=stored(self.buckets))

    def search(self, queries: DataFrame, q: QueryConfig, kind: str = "estimate") -> DataFrame:
        """(query_id, rank, point_id, score) by bucket estimates or by the union of probed buckets (kind="hash")."""
        q.check(self.cfg)
        probed = probes(project(checked(queries, "vec", self.cfg.dim), self.cfg, "query_id"), q.n_probed_vectors)
        prefix = q.prefix(self.cfg)
        if kind == "hash":
            if sent_whole(self.cfg, prefix):
                return hash_scored(self.buckets, probed, prefix, self.points.withColumnRenamed("seq", "point_id"), queries, q.k)
            return hash_searched(self.buckets, probed, prefix, self.points.withColumnRenamed("seq", "point_id"), queries, q.k, self.cfg.directions)
        elif kind == "estimate":
            found = bucket_best(self.buckets, probed, prefix, q.n_cand, q.estimator, self.cfg)
        else:
            raise ValueError("kind must be estimate or hash")
        return rerank(found, self.points.withColumnRenamed("seq", "point_id"), queries, q.k)


def _buckets(points: DataFrame, cfg: IndexConfig, mean: tuple[float, ...] | None) -> DataFrame:
    used = points.withColumnRenamed("seq", "point_id")
    return build_buckets(center(used, list(mean)) if mean else used, cfg)


class StreamingIndex:
    """A sink for foreachBatch: every micro-batch makes a new version of the index; readers of the last keep theirs.

    With `window` the newest that many points are held, of the batch too where it is larger. A version is a folder under `path` (in the shared folder unless given): the batch's points,
    the buckets, and, written last, what belongs to it. A new sink on the same path, as after the loss of the driver, goes on from the last whole version, and a batch that comes again is left out.
    """

    def __init__(self, cfg: IndexConfig, window: int | None = None, mode: str = "incremental", path: str | None = None):
        if window is not None and window < cfg.top_m:
            raise ValueError("the window would be smaller than a bucket")
        self.cfg, self.window, self.mode, self.path = cfg, window, mode, path
        self.state: WindowIndex | None = None
        #: tables of live points with the greatest seq of each
        self.last, self.parts, self.low = -1, {}, None
        self.opened = False

    def open(self, spark: SparkSession) -> WindowIndex | None:
        """The last whole version on the path."""
        if not self.opened:
            self.path, self.opened = self.path or fresh_path(spark, "stream"), True
            whole = [p for p in names_in(spark, f"{self.path}/version=*/whole/_SUCCESS")]
            if whole:
                self.last = int(whole[-1].split("/version=")[1].split("/")[0])
                got = json.loads(spark.read.text(f"{self._folder()}/whole").first()[0])
                if got["cfg"] != asdict(self.cfg):
                    raise ValueError("the path has an index of other parameters")
                self.parts, self.low = got["parts"], got["low"]
                self._load(spark, got["mean"])
        return self.state

    def _folder(self, version: int | None = None) -> str:
        return f"{self.path}/version={self.last if version is None else version:012d}"

    def _versions(self) -> set[int]:
        return {int(name.split("/")[0].removeprefix("version=")) for name in self.parts}

    def _load(self, spark: SparkSession, mean) -> None:
        points = spark.read.schema("seq long, vec array<double>").parquet(*[f"{self.path}/{name}" for name in self.parts])
        buckets = spark.read.schema("dir int, sgn int, rk int, point_id long, val double").parquet(f"{self._folder()}/buckets")
        self.state = WindowIndex(points.filter(F.col("seq") >= self.low), buckets, self.cfg, tuple(mean) if mean else None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.open(spark)
        if batch_id <= self.last:  # a batch that comes again is already in
            return
        batch = batch.select(F.col("seq").cast("long").alias("seq"), F.col("vec").cast("array<double>").alias("vec"))
        got = batch.agg(F.count("*").alias("n"), F.max("seq").alias("top")).first()
        n, top = got["n"], got["top"]
        if not n:
            return
        if self.window and n > self.window:
            batch, n = batch.filter(F.col("seq") >= id_at(batch, "seq", n - self.window)), self.window
        batch.write.mode("overwrite").parquet(f"{self._folder(batch_id)}/points")
        batch = spark.read.schema("seq long, vec array<double>").parquet(f"{self._folder(batch_id)}/points")
        held = self.state.points.count() if self.state else 0
        over = max(0, held + n - self.window) if self.window else 0
        if self.state is None:
            state = WindowIndex.build(batch, self.cfg)
        elif over >= held:
            state = self.state.replaced(batch)
        else:
            state = self.state.update(batch, over, self.mode)
        state.buckets.select(F.col("dir").cast("int").alias("dir"), F.col("sgn").cast("int").alias("sgn"), F.col("rk").cast("int").alias("rk"), "point_id", "val").write.mode("overwrite").parquet(f"{self._folder(batch_id)}/buckets")
        low = state.points.agg(F.min("seq")).first()[0]
        before = self._versions() | ({self.last} if self.last >= 0 else set())
        own = f"version={batch_id:012d}"
        self.parts, self.low = {name: t for name, t in self.parts.items() if t >= low} | {f"{own}/points": top}, low
        if len(self.parts) > PARTS:
            state.points.write.mode("overwrite").parquet(f"{self.path}/{own}/merged")
            self.parts = {f"{own}/merged": top}
        whole = {"cfg": asdict(self.cfg), "mean": state.mean, "parts": self.parts, "low": low}
        spark.createDataFrame([(json.dumps(whole),)], "value string").write.mode("overwrite").text(f"{self._folder(batch_id)}/whole")
        self.last = batch_id
        self._load(spark, state.mean)
        # the version before stays for its readers; older ones stay only while their points are in the window
        for v in names_in(spark, f"{self.path}/version=*"):
            number = int(v.split("/version=")[1].split("/")[0])
            if number not in before and number not in self._versions() and number < batch_id:
                drop_path(spark, v)

    def run(self, stream: DataFrame) -> WindowIndex | None:
        """Take in what is new and return the last version."""
        self.open(stream.sparkSession)
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.state
