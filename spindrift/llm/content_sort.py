"""Exact duplicates by sorting content.

Sampled splitters deal (prefix, digest) ranges of the normalised texts to partitions, an external sort makes
equal texts neighbours, and the sort aggregate compares whole neighbouring texts. Before the shuffle every task
folds its own equal texts into one row, so a text that fills a third of the table travels once per task
and 16 MB of distinct text, not once per row.

Defined cases: a null text counts as empty; very long texts are compared whole; of texts of most code points the smallest doc_id stays; rows without id rank after all others in their group; an empty
table gives an empty result; rows repeated under one id are one document, of which one row has kept = true;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_name, rows_of, small_batches, steady, whole_text

SPACE = b" \t\n\x0b\x0c\r"
#: The same characters as a pattern.
SPACE_RX = "[ \\t-\\r]+"
FLUSH_BYTES = 16 << 20
PREFIX = 32
_PREAGG = "prefix binary, digest binary, norm binary, n long, n_chars long, id long"


def _fold(batches):
    """One row for the equal texts of a task, until FLUSH_BYTES of distinct text are held."""
    seen: dict[bytes, list] = {}
    held = 0

    def flush():
        rows = list(seen.values())
        cols = list(zip(*rows)) or [[]] * 6
        schema = pa.schema([("prefix", pa.binary()), ("digest", pa.binary()), ("norm", pa.binary()), ("n", pa.int64()), ("n_chars", pa.int64()), ("id", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            norm = text.encode().translate(None, SPACE)
            digest = hashlib.sha256(norm).digest()
            row = seen.get(digest)
            if row is not None and row[2] == norm:
                row[3] += 1
                better = (len(text), doc_id is not None, -(doc_id or 0)) > (row[4], row[5] is not None, -(row[5] or 0))
                if better:
                    row[4], row[5] = len(text), doc_id
                continue
            seen[digest] = [norm[:PREFIX], digest, norm, 1, len(text), doc_id]
            held += len(norm) + 200
            if held > FLUSH_BYTES:
                yield flush()
                seen, held = {}, 0
    if seen:
        yield flush()


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, keep_chars, group_size."""
    spark = docs.sparkSession
    small_batches(spark)
    folded = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).mapInArrow(_fold, _PREAGG)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = F.max(F.struct(F.col("n_chars").alias("c"), (-F.col("id")).alias("m")))
    ranged = folded.repartitionByRange(parts, "prefix", "digest")
    groups = ranged.groupBy("prefix", "digest", "norm").agg(F.sum("n").alias("group_size"), best.alias("best"))
    return groups.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        (-F.col("best.m")).alias("keep_id"),
        F.col("best.c").alias("keep_chars"),
        F.col("group_size"),
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the name of the row."""
    groups = content_groups(docs, id_col, text_col)
    text = whole_text(text_col)
    light = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACE_RX, "").cast("binary"), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("c"),
        row.alias("row"),
    )
    again = Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("c"), "row")
    light = light.withColumn("again", F.row_number().over(again))
    out = light.join(groups, "text_sha256", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _marked(docs, id_col, text_col, F.monotonically_increasing_id()).drop("row")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; texts meet the decision by the name of their row, in one exchange."""
    docs = steady(docs)
    return rows_of(docs, _marked(docs, id_col, text_col, row_name(docs)).filter("kept").select("row"))
