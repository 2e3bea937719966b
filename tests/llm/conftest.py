import pytest

PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in quiet rooms"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, null and repeated ids, and columns that clash with results."""
    rows = [
        (1, PLAIN, "en", 5.0), (2, PLAIN, "en", 5.0), (2, PLAIN, "en", 5.0), (3, "  " + PLAIN.replace(" ", "\n") + " ", None, 5.0), (4, None, "en", None), (5, "", None, 1.0),
        (6, " \t\r\n", "en", 1.0), (None, "one line only", "en", 1.0), (7, "Ünï İSTANBUL ΑΣ <|endoftext|> 你好 😀 1²½", "xx", 1.0), (8, "x" * 30_000 + " " + "word " * 20_000, "en", 1.0),
        (9, PLAIN.upper(), "en", 1.0), (10, PLAIN + " extra", "en", 1.0), (-11, "a b", "en", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = 12345")


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
