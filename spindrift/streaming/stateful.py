"""A bucket index whose state lives in the stream: each direction and sign is a key of the state store, and a micro-batch merges its entries there.

Tasks reduce their points to top_m + reserve entries a key before the shuffle, and tell every key the greatest seq that they have seen, so that with a window of so many numbers the old entries leave. Nothing of the index is read or written by the driver, and a query that starts
again on its checkpoint goes on from the state. A bucket holds all points of the window above its floor, as in `reserve`; as the points themselves are not in the state, a bucket that runs short cannot be filled again, and is given with complete = false.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.index import BUCKET, _local_buckets
from ..plans import IndexConfig
from ..sources.tables import names_in

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "dir int, sgn int, rk int, point_id long, val double, complete boolean, upto long"


def _entries(cfg: IndexConfig):
    """As the build's, with the greatest id of the task in each row."""
    build = _local_buckets(cfg)

    def run(batches):
        upto = -1

        def watched():
            nonlocal upto
            for b in batches:
                if b.num_rows:
                    upto = max(upto, int(b.column(0).to_numpy(zero_copy_only=False).max()))
                yield b

        for b in build(watched()):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, upto, dtype=np.int64))], names=[*b.schema.names, "upto"])

    return run


class Buckets(StatefulProcessor):
    """State of a key: ids and values, best first; the floor, below which points may be missing (none: -inf); the greatest seq seen."""

    def __init__(self, top_m: int, reserve: int, window: int | None):
        self.top_m, self.most, self.window = top_m, top_m + reserve, window

    def init(self, handle) -> None:
        self.state = handle.getValueState("bucket", "ids array<long>, vals array<double>, floor double, upto long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        ids, vals, floor, upto = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf, -1
        if self.state.exists():
            got = self.state.get()
            ids, vals, floor, upto = np.array(got[0], dtype=np.int64), np.array(got[1], dtype=float), got[2], got[3]
        for r in rows:
            upto = max(upto, int(r["upto"].max()))
            ids, vals = np.append(ids, r["point_id"].to_numpy()), np.append(vals, r["val"].to_numpy())
            order = np.lexsort((ids, -vals))
            order = order[vals[order] >= floor]
            if len(order) > self.most:
                floor = float(vals[order[self.most - 1]])
                order = order[: self.most]
            ids, vals = ids[order], vals[order]
        if self.window is not None:
            stays = ids > upto - self.window
            ids, vals = ids[stays], vals[stays]
        self.state.update((ids.tolist(), vals.tolist(), floor, upto))
        n = min(self.top_m, len(ids))
        complete = floor == -np.inf or len(ids) >= self.top_m
        yield pd.DataFrame({"dir": key[0], "sgn": key[1], "rk": np.arange(1, n + 1, dtype=np.int32), "point_id": ids[:n], "val": vals[:n], "complete": complete, "upto": upto}).astype({"dir": "int32", "sgn": "int32"})

    def close(self) -> None:
        pass


def bucket_stream(points: DataFrame, cfg: IndexConfig, window: int | None = None, reserve: int | None = None) -> DataFrame:
    """A stream of whole buckets (dir, sgn, rk, point_id, val, complete, upto), of each key that a micro-batch touches, which is every key. points: a stream of (seq, vec), seq without gaps where there is a window.

    The session has to keep state in RocksDB (PROVIDER).
    """
    if cfg.centering:
        raise ValueError("a stream has no mean to take off")
    if window is not None and window < cfg.top_m:
        raise ValueError("the window would be smaller than a bucket")
    reserve = max(1, cfg.top_m // 2) if reserve is None else reserve
    typed = points.select(F.col("seq").cast("long").alias("point_id"), F.col("vec").cast("array<double>").alias("vec"))
    entries = typed.mapInArrow(_entries(replace(cfg, top_m=cfg.top_m + reserve)), BUCKET + ", upto long")
    return entries.groupBy("dir", "sgn").transformWithStateInPandas(Buckets(cfg.top_m, reserve, window), ROWS, "update", "none")


def run_bucket_stream(points: DataFrame, cfg: IndexConfig, path: str, window: int | None = None, reserve: int | None = None) -> DataFrame:
    """Take in what is new and return the buckets of the last micro-batch, which are under path with the checkpoint."""
    spark = points.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/buckets/batch={number:012d}")

        query = bucket_stream(points, cfg, window, reserve).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    done = names_in(spark, f"{path}/buckets/batch=*/_SUCCESS")
    return spark.read.schema(ROWS).parquet(done[-1].removesuffix("/_SUCCESS")) if done else spark.createDataFrame([], ROWS)
