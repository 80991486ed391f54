"""The registered queries over `documents`, `labels`, `benchmark` and `embeddings`, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import content_sort, imatch, lang_id, lines, mining, mixing, packing, pii, repair, resampling, secret_scan, simhash, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _on_documents(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(_documents(spark, sf_dir))

    return query


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampling_weights(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_language_mixture": _on_documents(lang_id.language_of),
    "op2_pattern_packing": _on_documents(packing.pack),
    "op3_secret_battery": _on_documents(secret_scan.secrets),
    "op4_bootstrapped_pii": _on_documents(pii.personal_data),
    "op5_toxic_grammar": op5_toxicity,
    "op6_imatch": _on_documents(imatch.fingerprint_pairs),
    "op7_covering_simhash": _on_documents(simhash.near_duplicates),
    "op8_pfair_mixing": _on_documents(mixing.mix),
    "op9_repeated_lines": _on_documents(lines.repeated_units),
    "op10_content_sort": _on_documents(content_sort.exact_dedup),
    "op11_resampling": op11_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_grammar_ids": _on_documents(repair.grammar_ids),
}

ORACLE_SQL = {
    "op6_imatch": imatch.ORACLE_SQL,
    "op9_repeated_lines": lines.ORACLE_SQL,
    "op11_resampling": resampling.ORACLE_SQL,
    "op12_hard_negatives": mining.ORACLE_SQL,
    "op10_content_sort": r"""
        with d as (
            select doc_id, length(coalesce(text, '')) as c, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', '', 'g')) as text_sha256
            from documents
        ), g as (
            select text_sha256, first(doc_id order by c desc, doc_id) as keep_id, count(*) as group_size from d group by text_sha256
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
    """,
}
