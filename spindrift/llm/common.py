"""Helpers that several operators share: shared-folder tables, span search, prefix ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import drop_since, mark, stored  # noqa: F401

#: Rows in one Arrow batch.
BATCH_ROWS = 512
#: Matches whose offsets are summed up in one go.
BLOCK = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS in this session where it has Spark's own number; spark.sql.execution.arrow.maxBytesPerBatch bounds the bytes of long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def _of_files(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a Parquet file: filters and projections of a scan, nothing else."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(row_name(docs)).schema
    except AnalysisException:
        return False
    return True


def steady(docs: DataFrame) -> DataFrame:
    """docs whose rows have names (row_name) that are the same in each scan: as it is if read from Parquet files, else stored first."""
    return docs if _of_files(docs) else stored(docs)


def row_name(docs: DataFrame) -> Column:
    """struct<file, row> of each row of steady docs: a hash of its file's path and its place in the file. Numbers by partition would not do: files are split by the cores that are there when a scan is run."""
    place = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))


def rows_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of steady docs whose names are in rows (row), all columns unchanged, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_name(docs).alias("row"))
    return whole.join(rows, "row", "left_semi").select(*[F.col("whole")[c].alias(c) for c in docs.columns])


def whole_text(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def find_spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<start,end,hit,gap>> of the leftmost non-overlapping matches, in code points.

    `split` gives the gaps and `regexp_extract_all` the matches of the same scan, so running lengths are the
    offsets. `gate` is a cheap condition without which there is no match; the pattern must not match nothing.
    """
    rx = F.lit(pattern)
    hits, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda p: p["hit"].isNotNull())
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,gap:string>>)")
    zero = F.lit(0)

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = begin + F.length(p["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), p["hit"].alias("hit"), p["gap"].alias("gap"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(some: Column) -> Column:
        return F.aggregate(some, F.struct(zero.alias("at"), empty.alias("out")), step)

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["hit"].alias("hit"), s["gap"].alias("gap")))

    def joined(blocks: Column) -> Column:
        # where each block starts; an array that grows is copied at every step, so blocks keep long texts from quadratic time
        ends = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(ends, 1, F.size(blocks)), lambda b, at: moved(b["out"], at)))

    def cut(ps: Column) -> Column:
        numbers = F.sequence(zero, F.floor((F.size(ps) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: block(F.slice(ps, k * BLOCK + 1, F.lit(BLOCK))))

    found = let(pairs, lambda ps: F.when(F.size(ps) <= BLOCK, block(ps)["out"]).otherwise(let(cut(ps), joined)))
    there = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(there, found).otherwise(empty)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def beside(rows: DataFrame, items: str, known: str, fields: str) -> DataFrame:
    """(row, start, end, `fields`, beside) of each of a row's items: whether it overlaps none of its known spans. items: array<struct<start,end,fields>>, known: array<struct<start,end,..>>.

    Both are laid out in order of start, and each item looks at the known span that reaches furthest before it and at the next one; so a text of many of both takes no product of them.
    """
    none = F.expr(f"cast(null as struct<{fields}>)")
    names = [f.split(":")[0] for f in fields.split(",")]
    own = F.transform(items, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.struct(*[x[n].alias(n) for n in names]).alias("item")))
    other = F.transform(known, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), none.alias("item")))
    flat = rows.select("row", F.inline(F.concat(own, other))).withColumn("own", F.col("item").isNotNull())
    # of equal starts the known span comes first in both; two orders with running values: a frame that reaches to the end would be worked out anew for each row
    forth = Window.partitionBy("row").orderBy("start", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("start"), "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(~F.col("own"), F.col("end"))).over(forth)
    following = F.min(F.when(~F.col("own"), F.col("start"))).over(back)
    flat = flat.withColumns({"reach": reach, "following": following}).filter("own")
    apart = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("following").isNull() | (F.col("following") >= F.col("end")))
    return flat.select("row", "start", "end", *[F.col("item")[n].alias(n) for n in names], apart.alias("beside"))


def normal_cdf(z: Column) -> Column:
    """Logistic-cubic approximation of the normal distribution function; error below 2e-4."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 16) -> int:
    return max(least, -(-rows // per_bucket))


def prefix_offsets(counts: DataFrame, keys: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Exclusive running sums of `value` over `bucket` for each key; counts has one row per (key, bucket)."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, bucket, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))
