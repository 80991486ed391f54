"""Rows keep their names when a table is split in another way between two scans, as where executors come or go."""

import pytest

from spindrift.llm import content_sort, lines, mixing, near_copies, simhash
from spindrift.llm.common import row_name, steady

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"
OPERATORS = {
    "exact": content_sort.keep_first_copies,
    "near": near_copies.keep_representatives,
    "simhash": simhash.keep_representatives,
    "mixing": mixing.mixed_order,
    "lines": lines.remove_repeated,
}


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "documents.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(11).write.parquet(path)
    return path


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_outlast_other_splits(spark, files, name):
    docs = spark.read.parquet(files)
    try:
        want = sorted(map(str, OPERATORS[name](docs).collect()))
        spark.conf.set(PARALLELISM, "1")
        got = OPERATORS[name](docs)
        spark.conf.set(PARALLELISM, "64")
        assert sorted(map(str, got.collect())) == want and len(want) > 100
    finally:
        spark.conf.unset(PARALLELISM)


def test_what_is_not_rows_of_files_is_stored(spark, files):
    docs = spark.read.parquet(files)
    for same in (docs, docs.filter("doc_id > 3").select("doc_id", "text")):
        assert steady(same) is same
    for other in (docs.union(docs), docs.join(docs.select("doc_id"), "doc_id"), docs.repartition(3), docs.sample(0.5), docs.selectExpr("explode(array(1, 2)) as x"), spark.range(5)):
        kept = steady(other)
        assert kept is not other and kept.select(row_name(kept)).distinct().count() == kept.count()
