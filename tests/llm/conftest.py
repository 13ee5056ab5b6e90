import pytest

#: Documents that hold every edge: null in each column, empty and blank texts, a very long text, ties, a repeated row, extra columns with clashing names.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, rank string"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank while seven wise owls watch from the old oak tree in silence tonight"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace(" ", "\n\t "), "en", "b", 1), (4, base + " again", None, "b", None), (5, None, "en", "b", 0),
        (6, "", "en", None, 0), (7, " \n\t ", "en", "c", 3), (None, base, "en", "c", 1), (8, LONG, "en", "c", len(LONG)), (9, LONG + " tail", "en", "a", 1), (10, "two words", "en", "é", 9),
        (11, "Two  Words", "en", "é", 10), (12, "naïve ünïcode 😀 text with more words than three", "fr", "z", 1), (13, "<|endoftext|> is ordinary or not", "en", "z", 1), (14, "one", "en", "z", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    """Rows of (doc_id, text) with null text as empty."""
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def small_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
