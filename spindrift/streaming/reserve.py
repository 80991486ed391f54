"""A sliding window whose buckets are always those of the whole window, without making them anew at each step.

A bucket holds `reserve` entries more than its top_m, and has a floor: it holds every point of the window that is not below the floor. New points enter where they are above it, old ones leave, and what is beyond top_m + reserve
raises it. Only a bucket that has fewer than top_m entries left, while there are points below its floor, is filled again from the window's points, in one pass for all such buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import center, checked, mean_vector
from ..operators.index import build_buckets, ranked_buckets
from ..plans import IndexConfig, QueryConfig
from ..sources.tables import stored
from . import WindowIndex


@dataclass
class ReserveWindow:
    """points: seq, vec; held: dir, sgn, rk, point_id (a seq), val; floors: dir, sgn, floor (val of the last entry that is surely held), floor_id; a bucket without a floor holds all points. refilled: buckets made anew by the last update."""

    points: DataFrame
    held: DataFrame
    floors: DataFrame
    cfg: IndexConfig
    reserve: int
    mean: tuple[float, ...] | None = None
    refilled: int = 0

    @classmethod
    def build(cls, points: DataFrame, cfg: IndexConfig, reserve: int | None = None) -> ReserveWindow:
        """reserve: half of top_m unless given."""
        reserve = max(1, cfg.top_m // 2) if reserve is None else reserve
        if reserve < 0:
            raise ValueError("reserve must not be negative")
        points = checked(points.select("seq", "vec"), "vec", cfg.dim)
        mean = tuple(mean_vector(points)) if cfg.centering else None
        made = cls(points, points, points, cfg, reserve, mean)
        held = stored(made._made(points))
        return replace(made, held=held, floors=made._floors(held))

    @property
    def _most(self) -> int:
        return self.cfg.top_m + self.reserve

    def _made(self, points: DataFrame, only: list[tuple[int, int]] | None = None) -> DataFrame:
        used = points.withColumnRenamed("seq", "point_id")
        return build_buckets(center(used, list(self.mean)) if self.mean else used, replace(self.cfg, top_m=self._most), only=only)

    def _floors(self, held: DataFrame) -> DataFrame:
        """Of the buckets that are full: their last entry."""
        return held.filter(F.col("rk") == self._most).select("dir", "sgn", F.col("val").alias("floor"), F.col("point_id").alias("floor_id"))

    @property
    def buckets(self) -> DataFrame:
        return self.held.filter(F.col("rk") <= self.cfg.top_m)

    def update(self, new: DataFrame | None, n_del: int = 0) -> ReserveWindow:
        """Append new points, then drop the n_del oldest of all; held and floors become tables in the shared folder."""
        points, added, first = WindowIndex(self.points, self.held, self.cfg, self.mean).slid(new, n_del)
        # floors are as many as directions and signs
        above = self._made(added).drop("rk").join(F.broadcast(self.floors), ["dir", "sgn"], "left")
        above = above.filter("floor is null or val > floor or val = floor and point_id < floor_id").drop("floor", "floor_id")
        stays = self.held.drop("rk") if first is None else self.held.drop("rk").filter(F.col("point_id") >= first)
        held = stored(ranked_buckets(stays.unionByName(above), self._most))
        raised = self._floors(held)
        floors = stored(raised.unionByName(self.floors.join(raised.select("dir", "sgn"), ["dir", "sgn"], "left_anti")))
        counts = held.groupBy("dir", "sgn").agg(F.count("*").alias("n"))
        short = sorted(tuple(r) for r in floors.join(counts, ["dir", "sgn"], "left").filter(F.coalesce("n", F.lit(0)) < self.cfg.top_m).select("dir", "sgn").collect())  # as many as directions and signs
        if short:
            keys = F.broadcast(points.sparkSession.createDataFrame(short, "dir int, sgn int"))
            filled = stored(self._made(points, short))
            held = stored(held.join(keys, ["dir", "sgn"], "left_anti").unionByName(filled))
            floors = stored(floors.join(keys, ["dir", "sgn"], "left_anti").unionByName(self._floors(filled)))
        return replace(self, points=points, held=held, floors=floors, refilled=len(short))

    def search(self, queries: DataFrame, q: QueryConfig, kind: str = "estimate") -> DataFrame:
        """As WindowIndex.search on the buckets of the whole window."""
        return WindowIndex(self.points, self.buckets, self.cfg, self.mean).search(queries, q, kind)
