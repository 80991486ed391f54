"""Repeated units of any length."""

from spindrift.llm import lines


def test_passage_of_short_sentences_and_short_lines_go(spark):
    passage = " ".join(f"Number {k} comes now. It was long, and nobody of them asked why {k} came." if k % 3 == 0 else f"Then came {k}." for k in range(12))
    rows = [
        (1, f"The first one begins like this. {passage} Its end is its own.\nRead more\nYes."),
        (2, f"Something else stands here. {passage} Yes.\nread  MORE\nThen came 99."),
        (3, "Yes. It was a short sentence with company of its own. Then came 4. Nothing else."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.remove_repeated(df).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Something else stands here. Yes.\n\nThen came 99."
    removed = {r["doc_id"]: r["removed"] for r in lines.remove_repeated(df).collect()}
    assert len(removed[2]) == 2


def test_short_lines_stay_where_asked(spark):
    df = spark.createDataFrame([(1, "Yes.\nThis line is long enough to go."), (2, "Yes.\nThis line is long enough to go.")], "doc_id long, text string")
    assert {r["start"] for r in lines.repeated_units(df).collect()} == {0, 5}
    assert [(r["doc_id"], r["start"]) for r in lines.repeated_units(df, line_words=4).collect()] == [(2, 5)]
