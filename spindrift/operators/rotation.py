"""Random directions as sign flips and Hadamard rounds, in two forms of equal values.

`project` with backend "sql" is one expression; backend "arrow" runs the same butterflies over whole batches.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flip, hadamard, pad, prefix
from ..plans import IndexConfig

ROUNDS = 3
#: Above so many outputs a vector, whole batches are faster than expressions.
SQL_LIMIT = 16
_M = 2**31 - 1


@lru_cache(maxsize=32)
def sign_bits(count: int, seed: int) -> tuple[int, ...]:
    """A multiplicative congruential stream (16807 modulo 2^31 - 1), halved to bits."""
    x, out = seed % _M or 1, []
    while len(out) < count:
        x = 16807 * x % _M
        if x - 1 < 2147483644:
            out.append((x - 1) // 1073741822)
    return tuple(out)


def round_bits(cfg: IndexConfig, repeat: int, rnd: int) -> list[int]:
    at = cfg.width * (ROUNDS * repeat + rnd)
    return list(sign_bits(cfg.width * ROUNDS * cfg.n_repeats, cfg.sign_seed)[at : at + cfg.width])


def sign_table(spark: SparkSession, cfg: IndexConfig) -> DataFrame:
    """(repeat, round, pos, bit); of the index's own, fixed size."""
    rows = [(r, i, p, b) for r in range(cfg.n_repeats) for i in range(ROUNDS) for p, b in enumerate(round_bits(cfg, r, i))]
    return spark.createDataFrame(rows, "repeat int, round int, pos int, bit int")


def rotate(v: Column, cfg: IndexConfig, repeat: int = 0, rounds: int = ROUNDS) -> Column:
    v = pad(v, cfg.width)
    for i in range(rounds):
        v = hadamard(flip(v, round_bits(cfg, repeat, i)), cfg.width)
    return v


def projection(v: Column, cfg: IndexConfig) -> Column:
    """Repeat r fills the directions from r * n_proj on."""
    return F.concat(*[prefix(rotate(v, cfg, r), cfg.n_proj) for r in range(cfg.n_repeats)])


def transform_batch(x: np.ndarray) -> np.ndarray:
    """The unnormalised transform of every row."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        a, b = y[:, :, 0], y[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(n, width)
        h *= 2
    return x


def project_batch(x: np.ndarray, cfg: IndexConfig) -> np.ndarray:
    parts = []
    for r in range(cfg.n_repeats):
        y = np.zeros((len(x), cfg.width))
        y[:, : x.shape[1]] = x
        for i in range(ROUNDS):
            y = transform_batch(y * (2.0 * np.array(round_bits(cfg, r, i)) - 1.0))
        parts.append(y[:, : cfg.n_proj])
    return np.hstack(parts)


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != dim * len(column):
        raise ValueError(f"vectors must have {dim} entries")
    return flat.reshape(len(column), dim)


def project(df: DataFrame, cfg: IndexConfig, id_col: str = "point_id", vec_col: str = "vec", backend: str | None = None) -> DataFrame:
    """(id, proj): narrow, without a shuffle."""
    if (backend or ("sql" if cfg.directions <= SQL_LIMIT else "arrow")) == "sql":
        return df.select(id_col, projection(F.col(vec_col), cfg).alias("proj"))

    def run(batches):
        for b in batches:
            y = project_batch(vectors_of(b.column(1), cfg.dim), cfg)
            offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * cfg.directions)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[id_col, "proj"])

    return df.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(run, f"{id_col} long, proj array<double>")


def long_projection(projected: DataFrame, id_col: str) -> DataFrame:
    """(id, dir, val)"""
    return projected.select(id_col, F.posexplode("proj").alias("dir", "val"))
