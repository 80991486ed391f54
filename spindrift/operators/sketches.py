"""How many candidates a hash search would have, before it is run: mergeable distinct-count sketches of the buckets.

A bucket's sketch (HyperLogLog of 2^LG registers) is made once with the index; the candidates of a query are the union of its probed buckets, whose sketch is the union of theirs, so an estimate reads one small row a probe instead of a bucket. The relative error is about
1.04 / sqrt(2^LG). With it the number of probes can be chosen for each query: as many as stay within a budget of candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

LG = 12


def bucket_sketches(buckets: DataFrame, prefix: int | None = None, lg: int = LG) -> DataFrame:
    """(dir, sgn, sketch) of the first `prefix` entries of each bucket, or of all; as a table, as it belongs to the index."""
    used = buckets if prefix is None else buckets.filter(F.col("rk") <= prefix)
    return stored(used.groupBy("dir", "sgn").agg(F.hll_sketch_agg("point_id", F.lit(lg)).alias("sketch")))


def estimated_candidates(sketches: DataFrame, probed: DataFrame) -> DataFrame:
    """(query_id, candidates): an estimate of the points in a query's probed buckets."""
    met = probed.select("query_id", "dir", "sgn").join(sketches, ["dir", "sgn"])
    return met.groupBy("query_id").agg(F.round(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).cast("long").alias("candidates"))


def probes_within(sketches: DataFrame, probed: DataFrame, budget: int, steps: list[int]) -> DataFrame:
    """(query_id, n_probed_vectors, candidates): of the numbers of probes in steps, the greatest whose estimate is within the budget, the least if none is."""
    met = probed.select("query_id", "dir", "sgn", "rk").join(sketches, ["dir", "sgn"])
    # a probe counts in each step that reaches it: as many rows as steps
    spread = met.select("query_id", "sketch", F.explode(F.filter(F.lit(sorted(steps)), lambda s: s >= F.col("rk"))).alias("step"))
    sizes = spread.groupBy("query_id", "step").agg(F.round(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).cast("long").alias("candidates"))
    best = F.max_by(F.struct("step", "candidates"), F.when(F.col("candidates") <= budget, F.col("step")).otherwise(-F.col("step")))
    return sizes.groupBy("query_id").agg(best.alias("best")).select("query_id", F.col("best.step").alias("n_probed_vectors"), F.col("best.candidates").alias("candidates"))


def narrowed(probed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The probes that were chosen for each query."""
    return probed.join(chosen.select("query_id", "n_probed_vectors"), "query_id").filter(F.col("rk") <= F.col("n_probed_vectors")).drop("n_probed_vectors")
