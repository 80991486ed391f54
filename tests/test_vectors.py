"""The data source of vector files."""

import numpy as np
import pytest

from spindrift import sources
from spindrift.sources.vectors import VectorSource, npy_header, vector_files

X = np.random.default_rng(8).normal(size=(9001, 5)).astype("<f4")


@pytest.fixture(scope="module")
def vectors(spark):
    spark.dataSource.register(VectorSource)
    return lambda **options: spark.read.format("vectors").options(**options)


def back(df):
    rows = df.orderBy("point_id").collect()
    assert [r["point_id"] for r in rows] == list(range(rows[0]["point_id"], rows[0]["point_id"] + len(rows)))
    return np.array([r["vec"] for r in rows])


@pytest.mark.parametrize("array", [X, X.astype("<f8"), X.astype(">f4"), np.asfortranarray(X.astype("<f8")), (X * 100).astype("i2"), X > 0], ids=["f4", "f8", "big", "columns", "i2", "bool"])
def test_ranges_of_arrays(spark, vectors, tmp_path, array):
    np.save(tmp_path / "x.npy", array)
    df = vectors(format="npy", bytes=4 * 5 * 700).load(f"{tmp_path}/x.npy")
    assert df.rdd.getNumPartitions() > 3
    assert (back(df) == array).all()
    assert (back(sources.read_npy(spark, f"file://{tmp_path}/x.npy")) == array).all()


def test_folders_and_first_rows(spark, vectors, tmp_path):
    for k, part in enumerate(np.array_split(X, 4)):
        (tmp_path / f"p{k}.bin").write_bytes(part.tobytes())
    (tmp_path / "_log").write_bytes(b"no rows")
    assert (back(sources.read_bin(spark, str(tmp_path), 5)) == X).all()
    assert (back(sources.read_bin(spark, str(tmp_path), 5, 3000)) == X[:3000]).all()
    with pytest.raises(ValueError):
        sources.read_bin(spark, str(tmp_path), 5, 9002)
    with pytest.raises(ValueError):
        sources.read_bin(spark, str(tmp_path), 7)
    with pytest.raises(ValueError):
        vector_files(f"{tmp_path}/none", "bin", 5)


def test_conditions_skip_ranges(spark, vectors, tmp_path):
    np.save(tmp_path / "x.npy", X)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = vectors(format="npy", skip="true", bytes=4 * 5 * 500).load(f"{tmp_path}/x.npy").filter("point_id >= 4000 and point_id < 4700")
        assert df.rdd.getNumPartitions() <= 3
        assert (back(df) == X[4000:4700]).all()
        assert vectors(format="npy", skip="true").load(f"{tmp_path}/x.npy").filter("point_id = 7").count() == 1
        assert vectors(format="npy", skip="true").load(f"{tmp_path}/x.npy").filter("point_id > 9000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_ids_alone_read_no_numbers(spark, vectors, tmp_path):
    (tmp_path / "x.npy").write_bytes(npy_header(50, 3))  # a header without rows
    df = vectors(format="npy").schema("point_id long").load(f"{tmp_path}/x.npy")
    assert [r["point_id"] for r in df.collect()] == list(range(50))


def test_written_side_by_side(spark, tmp_path):
    df = spark.createDataFrame([(int(k), [float(v) for v in x]) for k, x in enumerate(X[:3000])], "point_id long, vec array<double>").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sources.write_npy(df, f"{tmp_path}/x.npy")
        sources.write_bin(df, f"file://{tmp_path}/b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (np.load(tmp_path / "x.npy") == X[:3000]).all() and sorted(p.name for p in tmp_path.iterdir()) == ["b", "x.npy"]
    names = sorted(p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith("."))
    assert len(names) > 1 and b"".join((tmp_path / "b" / n).read_bytes() for n in names) == X[:3000].tobytes()
    sources.write_npy(df.limit(0), f"{tmp_path}/none.npy")
    assert np.load(tmp_path / "none.npy").shape == (0, 0)
    with pytest.raises(Exception):
        sources.write_bin(df.selectExpr("point_id", "if(point_id = 5, array(1.0), vec) as vec"), f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").iterdir() if p.name.startswith("part-")]
