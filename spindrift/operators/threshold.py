"""Candidates of a bucket search without reading whole buckets: sorted access in rounds with bounds.

The best estimates of a query are the greatest sums of a point's values over the probed buckets, in which a point that is not in a bucket counts as nothing. Buckets are read from their greatest values on, FIRST entries at first and GROWTH times as
many each round. What a point may still get from a bucket is at most the last value read there, and at least nothing or, where values are below zero, the bucket's last one; a point that was not seen at all gets at most the sum of these last values.
A query is settled when its n_cand-th lower bound is above every other point's upper bound; then only its candidates' entries are fetched, for their sums. The other queries read on, at the end to the last entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .index import best_candidates, probed_entries
from .topk import top_per_group

FIRST, GROWTH = 16, 4
#: Sums are rounded, so bounds have to be apart by this share.
SLACK = 1e-9


def threshold_candidates(buckets: DataFrame, probed: DataFrame, prefix: int, n_cand: int, first: int = FIRST, growth: int = GROWTH, report: list | None = None) -> DataFrame:
    """(query_id, point_id, est, rank): the rows of best_candidates(bucket_estimates(buckets, probed, prefix), n_cand). report: gets (entries of a bucket read by then, queries still open, entries read in the round) for each round."""
    used = buckets.filter(F.col("rk") <= prefix)
    sizes = stored(used.groupBy("dir", "sgn").agg(F.max("rk").alias("size"), F.min("val").alias("end")))  # as many as directions and signs
    lists, chosen, depth, before = stored(probed.select("query_id", "dir", "sgn")), None, first, 0
    active = lists
    while True:
        depth = min(depth, prefix)
        read = used.filter(F.col("rk") <= depth)
        last = read.groupBy("dir", "sgn").agg(F.min("val").alias("last")).join(sizes, ["dir", "sgn"])
        whole = F.col("size") <= depth
        bounds = last.select("dir", "sgn", F.when(whole, 0.0).otherwise(F.greatest("last", F.lit(0.0))).alias("up"), F.when(whole, 0.0).otherwise(F.least("end", F.lit(0.0))).alias("low"))
        mine = active.join(F.broadcast(bounds), ["dir", "sgn"])
        totals = mine.groupBy("query_id").agg(F.sum("up").alias("ups"), F.sum("low").alias("lows"))
        seen = mine.join(read.select("dir", "sgn", "point_id", "val"), ["dir", "sgn"]).groupBy("query_id", "point_id").agg(F.sum("val").alias("part"), F.sum("up").alias("up"), F.sum("low").alias("low"), F.count("*").alias("entries"))
        scored = seen.join(totals, "query_id").select("query_id", "point_id", "entries", "ups", (F.col("part") + F.col("ups") - F.col("up")).alias("upper"), (F.col("part") + F.col("lows") - F.col("low")).alias("lower"))
        placed = stored(top_per_group(scored, ["query_id"], [F.desc("lower"), F.col("point_id")], 1 << 30, "place"))
        inside = F.col("place") <= n_cand
        nth, other = F.min(F.when(inside, F.col("lower"))), F.greatest(F.coalesce(F.max(F.when(~inside, F.col("upper"))), F.first("ups")), F.first("ups"))
        settled = (F.count("*") >= n_cand) & (nth > other + SLACK * (F.abs(nth) + F.abs(other)))
        states = stored(placed.groupBy("query_id").agg(F.coalesce(settled | F.lit(depth >= prefix), F.lit(False)).alias("settled"), F.sum("entries").alias("entries")))
        now = placed.filter(inside if depth < prefix else F.lit(True)).join(states.filter("settled"), "query_id", "left_semi").select("query_id", "point_id")
        chosen = now if chosen is None else chosen.unionByName(now)
        got = states.agg(F.count("*").alias("n"), F.sum((~F.col("settled")).cast("int")).alias("open"), F.sum("entries").alias("entries")).first()
        if report is not None:
            report.append((depth, got["n"], (got["entries"] or 0) - before))
        if not got["open"]:
            break
        # what the open queries have read is not read for the first time in the next round
        before = states.filter("not settled").agg(F.sum("entries")).first()[0]
        active = active.join(states.filter("not settled").select("query_id"), "query_id", "left_semi")
        depth *= growth
    sums = lists.join(chosen, "query_id").join(used.select("dir", "sgn", "point_id", "val"), ["dir", "sgn", "point_id"]).groupBy("query_id", "point_id").agg(F.sum("val").alias("est"))
    return best_candidates(sums, n_cand)


def entries_of_all(buckets: DataFrame, probed: DataFrame, prefix: int) -> int:
    """What a search without bounds reads."""
    return probed_entries(buckets, probed, prefix).count()
