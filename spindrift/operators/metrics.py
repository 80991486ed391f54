"""What a search costs: seconds of its stages, rows and candidates, sizes and recall, as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans import IndexConfig, QueryConfig
from ..sources.tables import stored
from .exact import exact_search, rerank
from .index import MipsIndex, candidate_counts, recall, size_report
from .ivf import ivf_pq_search, ivf_search

_STAGES = "stage string, seconds double, rows long"


class StageClock:
    """Runs each stage as a table of its own in the shared folder and notes its seconds and, by observation on the way, its rows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        seen, started = Observation(), time.perf_counter()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        self.rows.append((stage, time.perf_counter() - started, seen.get["rows"]))
        return out

    def report(self) -> DataFrame:
        """stage, seconds, rows, and a last row `total` of the sums."""
        rows = self.spark.createDataFrame(self.rows, _STAGES)
        return rows.unionByName(rows.agg(F.lit("total").alias("stage"), F.sum("seconds").alias("seconds"), F.sum("rows").alias("rows")))


def measured_search(points: DataFrame, queries: DataFrame, cfg: IndexConfig, q: QueryConfig, kind: str = "bucket") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, stages, sizes): a search with its stages (build, probe, candidates, rerank) one after another, and bytes and mean candidates of a query."""
    clock = StageClock(points.sparkSession)
    index = MipsIndex.build(points, cfg, kind)
    index.table = clock.run("build", index.table)
    clock.run("probe", index.probe(queries, q))
    found = clock.run("candidates", index.candidates(queries, q))
    results = clock.run("rerank", rerank(found, index.points, queries, q.k))
    return results, clock.report(), size_report(points, cfg).crossJoin(candidate_counts(found))  # a row each


def compared(points: DataFrame, queries: DataFrame, cfg: IndexConfig, q: QueryConfig, kinds: Iterable[str] = ("exact", "dense", "bucket", "hash", "ivf", "ivf_pq")) -> DataFrame:
    """A row per kind of search: kind, build_seconds, search_seconds, recall."""
    spark = points.sparkSession
    searches: dict[str, Callable[[], DataFrame]] = {
        "exact": lambda: exact_search(points, queries, q.k),
        "ivf": lambda: ivf_search(points, queries, q.k),
        "ivf_pq": lambda: ivf_pq_search(points, queries, q.k, n_cand=q.n_cand),
    }
    truth, out = stored(exact_search(points, queries, q.k)), []
    for kind in kinds:
        built = 0.0
        if kind in searches:
            search = searches[kind]
        else:
            started = time.perf_counter()
            index = MipsIndex.build(points, cfg, kind)
            index.table = stored(index.table)
            built = time.perf_counter() - started
            search = lambda index=index: index.search(queries, q)
        started = time.perf_counter()
        found = stored(search())
        out.append((kind, built, time.perf_counter() - started, float(recall(found, truth, q.k).first()["recall"])))
    return spark.createDataFrame(out, "kind string, build_seconds double, search_seconds double, recall double")
