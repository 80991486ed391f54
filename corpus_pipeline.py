"""From raw documents to packed sequences: each stage works on what the one before it kept.

Defined cases: null, empty and very long texts, ties, repeated rows, rows without id and clashing column names are as the operator of each stage says; in all, a text without a letter goes at the first stage,
and an empty table stays empty to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import content_sort, lang_id, mixing, near_copies, packing
from spindrift.llm.common import drop_since, mark, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that makes up a quarter of them, go."""
    return lang_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 of five-word shingles."""
    return near_copies.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, and so the files, come in the order of the schedule, which the packed sequences follow."""
    return mixing.mixed_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in the order of the files' rows."""
    return packing.pack(docs, in_order=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenization, fingerprints and the learned language model have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table; the tables that led to it are removed once it is written, as the next stage reads it alone."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_since(spark, since, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
