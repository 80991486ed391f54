"""Connected components of an edge table, without collecting links or members anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, mark, stored


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _mins(both).withColumn("m", F.least("u", "m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _mins(down)
    joined = down.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge (u, v); root is the smallest node reachable.

    Alternating large and small stars; each round is a table in the shared folder, so lineage stays short, and the round before is removed.
    Edges with a null node are left out; repeated edges and loops change nothing; an empty edge table gives an empty result.
    """
    since = mark()
    edges = edges.filter("u is not null and v is not null")
    edges = stored(edges.select("u", "v").filter("u != v").distinct())
    before = _state(edges)
    for _ in range(max_rounds if before[0] else 0):
        edges = stored(_small_star(_large_star(edges)))
        drop_since(edges.sparkSession, since, keep=1)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
