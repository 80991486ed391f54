"""Vector files as a Spark data source: headerless float32 (.bin) and NumPy (.npy), read and written in byte ranges side by side.

spark.read.format("vectors") gives (point_id, vec): ids are positions in the files in order of name. Options: path (a file or a folder), format (bin or npy), dim (of bin), rows (only the first so many), bytes (of a partition). A header is read once,
rows are found by their offset, a schema without `vec` reads no numbers, and with skip=true, for which
spark.sql.python.filterPushdown.enabled has to be set, conditions on point_id leave ranges out.

df.write.format("vectors") writes a folder of files, one a task, in order of partitions: a task writes under a name of its own attempt, and files get their names when all tasks are done.
Paths are those of any file system that pyarrow reads on all executors, as a mounted folder.
"""

from __future__ import annotations

import ast
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

BYTES = 64 << 20
#: Rows of an Arrow batch.
ROWS = 4096


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; ValueError where pyarrow has none."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as error:
        raise ValueError(f"{path}: no file system that pyarrow reads") from error


@dataclass(frozen=True)
class VectorFile:
    """Where the numbers of a file begin, and how they lie."""

    path: str
    begin: int
    rows: int
    dim: int
    dtype: str
    by_column: bool = False


def _npy(fs: pafs.FileSystem, path: str) -> VectorFile:
    with fs.open_input_file(path) as f:
        head = f.read_at(12, 0)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path}: not an array file")
        long = head[6] > 1
        begin, size = (12, int.from_bytes(head[8:12], "little")) if long else (10, int.from_bytes(head[8:10], "little"))
        got = ast.literal_eval(f.read_at(size, begin).decode("utf-8" if head[6] > 2 else "latin-1"))
    shape = got["shape"]
    if len(shape) != 2:
        raise ValueError(f"{path}: an array of vectors has two dimensions")
    return VectorFile(path, begin + size, shape[0], shape[1], np.dtype(got["descr"]).str, got["fortran_order"])


def vector_files(path: str, kind: str, dim: int = 0) -> list[VectorFile]:
    """The files of a path in order of name."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"{path}: no such file")
    infos = [info] if info.type == pafs.FileType.File else sorted((i for i in fs.get_file_info(pafs.FileSelector(place)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))), key=lambda i: i.base_name)
    if kind == "npy":
        found = [_npy(fs, i.path) for i in infos]
        if len({(f.dim, f.dtype) for f in found}) > 1:
            raise ValueError(f"{path}: arrays of more than one width or type")
        return found
    if dim < 1:
        raise ValueError("dim must be positive")
    for i in infos:
        if i.size % (4 * dim):
            raise ValueError(f"{i.path}: not whole rows of {dim} numbers")
    return [VectorFile(i.path, 0, i.size // (4 * dim), dim, "<f4") for i in infos]


class _Range(InputPartition):
    def __init__(self, file: VectorFile, first: int, rows: int, first_id: int):
        super().__init__((file, first, rows, first_id))


class VectorReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind = options["path"], options.get("format", "bin")
        self.dim, self.bytes = int(options.get("dim", 0)), int(options.get("bytes", BYTES))
        self.names = schema.names
        self.low, self.high = 0, int(options.get("rows", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        out, at = [], 0
        for file in vector_files(self.path, self.kind, self.dim):
            each = max(1, self.bytes // max(1, file.dim * np.dtype(file.dtype).itemsize))
            lo, hi = max(0, self.low - at), min(file.rows, self.high - at)
            out += [_Range(file, k, min(each, hi - k), at + k) for k in range(lo, hi, each)]
            at += file.rows
        return out or [_Range(VectorFile(self.path, 0, 0, 0, "<f4"), 0, 0, 0)]

    def read(self, partition):
        file, first, rows, first_id = partition.value
        kind, width = np.dtype(file.dtype), file.dim
        whole = kind.kind in "iub"
        if not rows:
            return
        with opened(self.path)[0].open_input_file(file.path) as f:
            for k in range(first, first + rows, ROWS):
                n = min(ROWS, first + rows - k)
                cols = {"point_id": pa.array(np.arange(n, dtype=np.int64) + first_id + k - first)}
                if "vec" in self.names:
                    if file.by_column:
                        x = np.stack([np.frombuffer(f.read_at(n * kind.itemsize, file.begin + (c * file.rows + k) * kind.itemsize), dtype=kind) for c in range(width)], axis=1) if width else np.zeros((n, 0))
                    else:
                        x = np.frombuffer(f.read_at(n * width * kind.itemsize, file.begin + k * width * kind.itemsize), dtype=kind)
                    x = np.ascontiguousarray(x).ravel().astype(np.int64 if whole else np.float32 if kind.itemsize <= 4 and self.kind == "bin" else np.float64)
                    cols["vec"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x))
                yield pa.RecordBatch.from_arrays([cols[c] for c in self.names], names=self.names)


class SkippingReader(VectorReader):
    """With conditions on point_id pushed down; Spark takes such a reader only where the session allows it."""

    def pushFilters(self, filters):
        for f in filters:
            on_id = getattr(f, "attribute", None) == ("point_id",) and isinstance(getattr(f, "value", None), int)
            if on_id and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if on_id and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            if not on_id or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    rows: int
    dim: int


class VectorWriter(DataSourceArrowWriter):
    """A file a task, float32; of .npy each with its own header."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if "vec" not in schema.names:
            raise ValueError("vectors are written from a column vec")
        self.path, self.kind, self.at, self.overwrite = options["path"].rstrip("/"), options.get("format", "bin"), schema.names.index("vec"), overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        fs, place = opened(self.path)
        fs.create_dir(place)
        part = TaskContext.get().partitionId()
        name = f"{place}/.part-{part:05d}-{uuid.uuid4().hex}"
        rows, dim = 0, None
        with fs.open_output_stream(name) as f:
            for b in iterator:
                column = b.column(self.at)
                sizes = np.unique(np.diff(column.offsets.to_numpy()))
                if column.null_count or len(sizes) > 1 or dim not in (None, *sizes):
                    raise ValueError("vectors of one file have one length")
                if len(sizes):
                    dim = int(sizes[0])
                    f.write(column.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                rows += b.num_rows
        return _Written(part, name, rows, dim or 0)

    def commit(self, messages):
        fs, place = opened(self.path)
        fs.create_dir(place)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(place)):
                if i.type == pafs.FileType.File and i.base_name.startswith("part-"):
                    fs.delete_file(i.path)
        dims = {m.dim for m in messages if m is not None and m.rows}
        if len(dims) > 1:
            raise ValueError("vectors of one folder have one length")
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.name, f"{place}/part-{m.part:05d}.raw" if self.kind == "npy" else f"{place}/part-{m.part:05d}.bin")
            elif m is not None:
                fs.delete_file(m.name)

    def abort(self, messages):
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.name).type == pafs.FileType.File:
                fs.delete_file(m.name)


class VectorSource(DataSource):
    @classmethod
    def name(cls):
        return "vectors"

    def schema(self):
        number = FloatType()
        if self.options.get("format") == "npy":
            found = vector_files(self.options["path"], "npy")
            number = LongType() if found and np.dtype(found[0].dtype).kind in "iub" else DoubleType()
        return StructType([StructField("point_id", LongType()), StructField("vec", ArrayType(number))])

    def reader(self, schema):
        return (SkippingReader if self.options.get("skip") == "true" else VectorReader)(self.options, schema)

    def writer(self, schema, overwrite):
        return VectorWriter(self.options, schema, overwrite)


def npy_header(rows: int, dim: int) -> bytes:
    """Of a float32 array by rows, filled up to a multiple of 64 bytes."""
    text = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {dim}), }}".encode()
    size = math.ceil((10 + len(text) + 1) / 64) * 64 - 10
    return b"\x93NUMPY\x01\x00" + size.to_bytes(2, "little") + text.ljust(size - 1) + b"\n"
