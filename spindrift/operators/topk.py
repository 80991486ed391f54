"""Top rows per group; ties go to the smaller id everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; each task keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, point_id, score) of the k best."""
    top = top_per_group(scored, ["query_id"], [F.desc("score"), F.col("point_id")], k)
    return top.select("query_id", "rank", "point_id", "score")


def probes(projected_queries: DataFrame, s: int) -> DataFrame:
    """(query_id, dir, sgn, mag, rk): the s directions on which the query is most extreme; zero counts as positive.

    Picked inside each row, without a shuffle.
    """
    entries = F.transform("proj", lambda x, i: F.struct((-F.abs(x)).alias("neg"), i.alias("dir"), F.when(x < 0, -1).otherwise(1).alias("sgn")))
    top = F.slice(F.array_sort(entries), 1, s)
    return projected_queries.select("query_id", F.posexplode(top).alias("rk", "e")).select("query_id", "e.dir", "e.sgn", (-F.col("e.neg")).alias("mag"), (F.col("rk") + 1).alias("rk"))


def to_matrix(results: DataFrame, k: int, pad: bool = False) -> DataFrame:
    """(query_id, ids, scores): arrays in order of rank, filled with zeros to k if pad."""
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "point_id", "score"))).alias("r"))
    ids, scores = F.col("r.point_id"), F.col("r.score")
    if pad:
        ids = F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), k)), 1, k)
        scores = F.slice(F.concat(scores, F.array_repeat(F.lit(0.0), k)), 1, k)
    return rows.select("query_id", ids.alias("ids"), scores.alias("scores"))
