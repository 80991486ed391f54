"""Every kept term of a long text counts in its fingerprint."""

from pyspark.sql import functions as F

from spindrift.llm import imatch


def test_long_texts_that_differ_in_left_out_subsets(spark):
    words = [f"w{k}" for k in range(4000)]
    base = " ".join(words)
    rows = [(0, base)] + [(k, base + f" extra{k}") for k in range(1, 9)]
    df = spark.createDataFrame(rows, "id long, text string")
    # no lexicon: all terms are kept
    sig = imatch.signatures(imatch.keys_of(imatch.terms(F.col("text")))).alias("sig")
    got = df.select("id", sig).select("id", imatch.shown(F.col("sig")).alias("fp"), "sig")
    assert len({r["fp"] for r in got.collect()}) == len(rows)
    one = got.filter("id = 0").select(F.col("sig").alias("a"))
    like = one.crossJoin(got).select("id", imatch.likeness(F.col("a"), F.col("sig")).alias("x")).collect()
    assert all((r["x"] == 1) == (r["id"] == 0) and r["x"] > 0.9 for r in like)
