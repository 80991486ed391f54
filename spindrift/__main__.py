"""Index a file of vectors and search it: python -m spindrift --points X.bin --queries Q.bin --dim 300 --out results"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators.exact import exact_search
from .operators.index import MipsIndex
from .operators.metrics import StageClock
from .plans import IndexConfig, QueryConfig, power_of_two
from .streaming import WindowIndex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    p.add_argument("--points", required=True)
    p.add_argument("--queries", required=True)
    p.add_argument("--format", choices=("bin", "txt", "npy", "parquet"), default="bin")
    p.add_argument("--dim", type=int, required=True)
    p.add_argument("--kind", choices=("exact", "dense", "bucket", "hash", "stream", "stream-hash"), default="bucket")
    p.add_argument("--update", help="of a stream kind: vectors that are appended to the window before the search, in the same format")
    p.add_argument("--n-del", type=int, default=0, help="of a stream kind: the oldest points that leave with the update")
    p.add_argument("--mode", choices=("incremental", "rebuild"), default="incremental")
    p.add_argument("--metrics", help="folder for the stages' seconds and rows, as JSON")
    p.add_argument("--n-proj", type=int)
    p.add_argument("--n-repeats", type=int, default=1)
    p.add_argument("--top-m", type=int, default=1000)
    p.add_argument("--seed", type=int, default=-1)
    p.add_argument("--centering", action="store_true")
    p.add_argument("--k", type=int, default=1)
    p.add_argument("--n-probed-vectors", type=int, default=10)
    p.add_argument("--n-probed-points", type=int)
    p.add_argument("--n-cand", type=int)
    p.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    read = {"bin": lambda f: sources.read_bin(spark, f, a.dim), "txt": lambda f: sources.read_txt(spark, f), "npy": lambda f: sources.read_npy(spark, f), "parquet": spark.read.parquet}[a.format]
    points, queries = read(a.points), read(a.queries).withColumnRenamed("point_id", "query_id")
    clock = StageClock(spark)
    if a.kind == "exact":
        found = exact_search(points, queries, a.k)
    else:
        cfg = IndexConfig(a.dim, a.n_proj or max(256, power_of_two(a.dim)), a.n_repeats, a.top_m, a.seed, a.centering)
        q = QueryConfig(a.k, a.n_probed_vectors, a.n_probed_points, n_cand=a.n_cand or a.k)
        if a.kind.startswith("stream"):
            window = WindowIndex.build(points.withColumnRenamed("point_id", "seq"), cfg)
            window.buckets = clock.run("build", window.buckets)
            if a.update or a.n_del:
                new = None
                if a.update:
                    last = points.agg(F.max("point_id")).first()[0]
                    new = read(a.update).select((F.col("point_id") + last + 1).alias("seq"), "vec")
                window = window.update(new, a.n_del, a.mode)
                window.buckets = clock.run("update", window.buckets)
            found = window.search(queries, q, "hash" if a.kind == "stream-hash" else "estimate")
        else:
            index = MipsIndex.build(points, cfg, a.kind)
            index.table = clock.run("build", index.table)
            found = index.search(queries, q)
    found = clock.run("search", found)
    if a.metrics:
        clock.report().coalesce(1).write.json(a.metrics)
    sources.write_results(found, a.out)


if __name__ == "__main__":
    main()
