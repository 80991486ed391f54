"""Tables in the cluster's shared folder, and row positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where none is set and all runs in one process, as in tests, a folder of our own. On a cluster a folder has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


#: Paths of the tables of this process that are not dropped yet.
_paths: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: computed once, safe if executors are lost."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    _paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """For drop_since: the number of tables now."""
    return len(_paths)


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Remove the tables stored since the mark but the last `keep`; nothing that is still to be computed may read them."""
    gone = _paths[mark : len(_paths) - keep]
    _paths[mark : len(_paths) - keep] = []
    for name in gone:
        drop_path(spark, name)


def with_row_ids(df: DataFrame, name: str = "point_id", file_order: bool = False) -> DataFrame:
    """Positions from 0, without moving rows: a count per run of rows, then an offset. In order of partitions, or, with file_order, of the files by name and of the parts of each:
    df then has columns `_file` and `_block`, a part's file and where it begins, which are dropped; Spark reads large files first, so partitions are not in the order of files.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    if not file_order:
        df = df.withColumns({"_file": F.lit(""), "_block": part})
    rows = df.select(*df.columns, at.alias("_at"))
    # a row per part of a file
    runs = sorted(rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())
    starts, total = [], 0
    for r in runs:
        starts.append((r["_file"], r["_block"], total - r["first"]))
        total += r["n"]
    placed = rows.join(df.sparkSession.createDataFrame(starts, "_file string, _block long, _start long"), ["_file", "_block"])
    return placed.select((F.col("_start") + F.col("_at")).cast("long").alias(name), *[c for c in df.columns if c not in ("_file", "_block")])


def id_at(df: DataFrame, col: str, rank: int) -> int:
    """The value of a column of distinct numbers that just `rank` rows are below: a sampled range first, then only the values in it are sorted."""
    n = df.count()
    if not 0 <= rank < n:
        raise ValueError("no row of this rank")
    share = [max(0.0, rank / n - 0.001), min(1.0, rank / n + 0.001)]
    low, high = df.agg(F.percentile_approx(col, share, 10_000).alias("q")).first()["q"]
    got = df.agg(F.sum((F.col(col) < low).cast("long")).alias("below"), F.sum((F.col(col) <= high).cast("long")).alias("upto")).first()
    inside, skip = (F.col(col).between(low, high), rank - got["below"]) if got["below"] <= rank < got["upto"] else (F.lit(True), rank)
    return df.filter(inside).select(col).orderBy(col).offset(skip).first()[0]


def drop_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def names_in(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, sorted; in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])
