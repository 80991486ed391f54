"""Vector files: headerless float32 (.bin), text (.txt) and NumPy (.npy), and the text sink of results."""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import with_row_ids
from .vectors import VectorSource, npy_header, opened, vector_files


def from_memory(spark: SparkSession, data, id_col: str = "point_id", vec_col: str = "vec") -> DataFrame:
    """(point_id, vec) of what is held in memory: a two-dimensional NumPy array (ids are positions), a pandas frame or an Arrow table (with both columns). Copied by way of Arrow."""
    if isinstance(data, np.ndarray):
        if data.ndim != 2:
            raise ValueError("an array of vectors has two dimensions")
        kind = pa.float32() if data.dtype == np.float32 else pa.float64()
        offsets = pa.array(np.arange(len(data) + 1, dtype=np.int64) * data.shape[1])
        vectors = pa.LargeListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(data).ravel(), kind)).cast(pa.list_(kind))
        data = pa.table({id_col: pa.array(np.arange(len(data), dtype=np.int64)), vec_col: vectors})
    elif not isinstance(data, pa.Table):
        data = pa.Table.from_pandas(data, preserve_index=False)
    return spark.createDataFrame(data.select([id_col, vec_col])).withColumnRenamed(id_col, "point_id").withColumnRenamed(vec_col, "vec")


def _vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectors").options(**options).load(path)


def read_bin(spark: SparkSession, path: str, dim: int, n: int | None = None) -> DataFrame:
    """(point_id, vec) of records of dim float32 numbers, of files in order of name; with n, the first n rows, an error if there are fewer."""
    files = vector_files(path, "bin", dim)
    if n is not None and sum(f.rows for f in files) < n:
        raise ValueError(f"{path} has fewer than {n} rows")
    return _vectors(spark, path, format="bin", dim=dim, **({} if n is None else {"rows": n}))


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """One vector a line, numbers apart by white space, of files in order of name; blank lines are skipped."""
    lines = spark.read.text(path)
    place = lines.metadataColumn("_metadata")
    lines = lines.select("value", place["file_path"].alias("_file"), place["file_block_start"].alias("_block")).filter(F.trim("value") != "")
    numbers = F.transform(F.split(F.trim(F.regexp_replace("value", "\\s+", " ")), " "), lambda x: x.cast("float"))
    return with_row_ids(lines.select(numbers.alias("vec"), "_file", "_block"), file_order=True)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, vec) of a two-dimensional array, or of a folder of them in order of name; whole numbers as longs, others as doubles. Ranges of rows are read side by side."""
    return _vectors(spark, path, format="npy")


def _ordered(df: DataFrame, id_col: str) -> DataFrame:
    return df.repartitionByRange(id_col).sortWithinPartitions(id_col)


def write_bin(df: DataFrame, path: str, id_col: str = "point_id", vec_col: str = "vec") -> None:
    """Part files in order of id."""
    _write(df, path, "bin", id_col, vec_col)


def _write(df: DataFrame, path: str, kind: str, id_col: str, vec_col: str) -> None:
    opened(path)
    df.sparkSession.dataSource.register(VectorSource)
    _ordered(df, id_col).select(F.col(vec_col).cast("array<float>").alias("vec")).write.format("vectors").option("format", kind).mode("append").save(path)


def write_txt(df: DataFrame, path: str, id_col: str = "point_id", vec_col: str = "vec") -> None:
    line = F.array_join(F.transform(vec_col, lambda x: x.cast("string")), " ").alias("value")
    _ordered(df, id_col).select(line).write.text(path)


def write_npy(df: DataFrame, path: str, id_col: str = "point_id", vec_col: str = "vec") -> None:
    """One array file in order of id, in a mounted folder: tasks write their rows to files of their own, and then, as their sizes are known, to their places in the file side by side."""
    fs, place = opened(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError(f"{path}: one file is written side by side in mounted folders only; .bin and Parquet go to others")
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    _write(df, folder, "npy", id_col, vec_col)
    parts = sorted((i for i in fs.get_file_info(pafs.FileSelector(opened(folder)[1])) if i.base_name.endswith(".raw")), key=lambda i: i.base_name)
    dim = df.select(F.size(vec_col)).first()[0] if parts else 0  # the writer has seen that all are alike
    head = npy_header(sum(i.size for i in parts) // (4 * dim) if dim else 0, dim)
    begin, work = len(head), []
    for i in parts:
        work.append((i.path, begin))
        begin += i.size
    made = f"{place}.new-{uuid.uuid4().hex}"
    with open(made, "wb") as f:
        f.write(head)
        f.truncate(begin)
    if work:
        spark = df.sparkSession
        spark.createDataFrame(work, "part string, begin long").repartition(len(work)).mapInArrow(_copier(made), "part string").count()
    os.replace(made, place)
    fs.delete_dir(opened(folder)[1])


def _copier(target: str):
    """Copies parts to their places; one that is copied again writes the same bytes."""

    def run(batches):
        for b in batches:
            for part, begin in zip(*(c.to_pylist() for c in b.columns)):
                with open(part, "rb") as source, open(target, "r+b") as f:
                    f.seek(begin)
                    shutil.copyfileobj(source, f, 1 << 22)
            yield b.select(["part"])

    return run


def write_results(results: DataFrame, path: str) -> None:
    """One line a query, in order: its point ids in order of rank, each followed by a space."""
    ids = F.sort_array(F.collect_list(F.struct("rank", "point_id")))["point_id"]
    lines = results.groupBy("query_id").agg(F.concat(F.array_join(ids, " "), F.lit(" ")).alias("value"))
    _ordered(lines, "query_id").select("value").write.text(path)
