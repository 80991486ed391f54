"""Vector expressions on array columns; sums are in double precision and in order of position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(v: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)


def pad(v: Column, width: int) -> Column:
    """Zeros behind, up to width."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), width)), 1, width)


def prefix(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    length = F.sqrt(norm2(v))
    return F.transform(doubles(v), lambda x: x / F.when(length == 0, 1.0).otherwise(length))


def lift_points(v: Column) -> Column:
    """{2x, -|x|^2}: its inner product with a lifted query ranks as the Euclidean distance does."""
    return F.concat(F.transform(doubles(v), lambda x: x * 2), F.array(-norm2(v)))


def lift_queries(v: Column) -> Column:
    return F.concat(doubles(v), F.array(F.lit(1.0)))


def sign_of(x: Column) -> Column:
    """Zero counts as positive."""
    return F.when(x < 0, -1).otherwise(1)


def flip(v: Column, bits: list[int]) -> Column:
    """Signs of the entries with bit 0 change."""
    return F.zip_with(v, F.lit([2.0 * b - 1.0 for b in bits]), lambda x, s: x * s)


def hadamard(v: Column, width: int) -> Column:
    """Unnormalised Walsh-Hadamard transform in natural order, by log2(width) butterfly stages."""
    h = 1
    while h < width:
        step = h

        def stage(a: Column) -> Column:
            def entry(x: Column, i: Column) -> Column:
                low = i.bitwiseAND(step) == 0
                return F.when(low, x + F.get(a, i + step)).otherwise(F.get(a, i - step) - x)

            return F.transform(a, entry)

        v = F.transform(F.array(v), stage)[0]
        h *= 2
    return v


def checked(df: DataFrame, vec_col: str, dim: int | None = None) -> DataFrame:
    """df without change; a null vector, a null or NaN entry or (with dim) a wrong length raises an error when rows are read."""
    v = F.col(vec_col)
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))
    if dim is not None:
        bad = bad | (F.size(v) != dim)
    fail = F.raise_error(F.lit(f"{vec_col}: vectors must have {dim or 'some'} entries, none null or NaN"))
    return df.withColumn(vec_col, F.when(F.coalesce(bad, F.lit(True)), fail.cast(df.schema[vec_col].dataType)).otherwise(v))


def column_mean(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """(pos, mean) of each position from 0; averages meet before the shuffle, so only positions travel."""
    return df.select(F.posexplode(doubles(F.col(vec_col))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def center(df: DataFrame, mean: list[float], vec_col: str = "vec") -> DataFrame:
    return df.withColumn(vec_col, F.zip_with(doubles(F.col(vec_col)), F.lit([float(m) for m in mean]), lambda x, m: x - m))


def mean_vector(df: DataFrame, vec_col: str = "vec") -> list[float]:
    """As many numbers as a vector has."""
    return [r["mean"] for r in sorted(column_mean(df, vec_col).collect(), key=lambda r: r["pos"])]
