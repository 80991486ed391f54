import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", kept string, fp string, start string, s string, row string, b string, hi string, rank string"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash."""
    long = "Some words that go on and on, number %d. " * 1 % 7 * 3000
    base = [
        (1, "The same text. It says little to anybody who reads it.", "en", "a"),
        (2, "The  same text.\nIt says little to anybody who reads it. ", "en", "a"),
        (1, "The same text. It says little to anybody who reads it.", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (5, " \t\n\x0b\x0c\r", "fr", None),
        (6, long, "en", "a"),
        (7, "1 2 3 4 5 " * 4000, "en", "a"),
        (8, "Un texte \U0001f600 français; écrire à moi.a@b.example.org ou +33 (1) 23-45-67-89.", "fr", "b"),
        (None, "No id here, but words all the same and more of them.", "en", "a"),
        (None, None, None, None),
        (9, "x" * 50000, "en", "a"),
        (10, "a@" * 2000 + "-1" * 3000 + "+" * 2000 + "1" * 9000, "de", "b"),
    ]
    return spark.createDataFrame([(*r, None, "k", "f", "s", "s", "r", "b", "h", "r") for r in base], EXTRA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
