"""The vector functions and a table function for search under SQL names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.exact import best_of
from ..operators.rotation import vectors_of

_BODIES = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vec_pad(a ARRAY<DOUBLE>, n INT) RETURNS ARRAY<DOUBLE>": "slice(concat(a, array_repeat(0D, n)), 1, n)",
    "vec_sign(x DOUBLE) RETURNS INT": "IF(x < 0, -1, 1)",
}


class MipsSearch:
    """mips_search(points => TABLE(...) PARTITION BY ..., query => ..., k => ...): the k points (point_id, vec: the first two columns) with the largest inner products, of each partition; ties go to the smaller id.

    Batches are scored as arrays. Each partition keeps k rows; for all points order and limit what comes out of the partitions.
    """

    def __init__(self):
        self.scores, self.ids = np.zeros((1, 0)), np.zeros((1, 0), dtype=np.int64)

    def eval(self, points: pa.RecordBatch, query: pa.Array, k: pa.Array):
        if points.num_rows:
            q, keep = np.array(query[0].as_py(), dtype=float), k[0].as_py()
            x = vectors_of(points.column(1), len(q))
            score = np.zeros(len(x))
            for j in range(len(q)):  # in order of position, so that every formulation adds up alike
                score += q[j] * x[:, j]
            both = np.append(self.scores, score[None], axis=1), np.append(self.ids, points.column(0).to_numpy(zero_copy_only=False)[None], axis=1)
            _, scores, ids = best_of(*both, keep)
            self.scores, self.ids = scores[None], ids[None]
        return iter(())

    def terminate(self):
        order = np.lexsort((self.ids[0], -self.scores[0]))
        yield pa.table({"point_id": pa.array(self.ids[0][order], pa.int64()), "score": pa.array(self.scores[0][order], pa.float64())})


def register(spark: SparkSession) -> None:
    spark.udtf.register("mips_search", arrow_udtf(MipsSearch, returnType="point_id: bigint, score: double"))
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
