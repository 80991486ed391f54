import duckdb
import pytest
import zlib

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == start.columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0
    assert docs.subtract(start).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_stages_survive_odd_tables(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.collect()
            docs = out if out.columns == docs.columns else docs
