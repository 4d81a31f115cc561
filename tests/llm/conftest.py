import pytest

#: Odd rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, columns that clash.
ODD = [
    (1, "the same words are here for a test of the sort"), (2, "the  same words\nare here for a test of the sort"), (3, None), (4, ""), (5, "   "),
    (6, "word " * 60_000), (7, "x" * 300_000), (8, "word " * 60_000), (9, "é ﬁ ẖ İ K ſ <|endoftext|> <s> ▁ a▁ b"), (10, "1234 !!! 🙂"), (11, "nul \0 in it"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "src", -1, 7) for i, t in ODD], "doc_id long, text string, lang string, source string, _rid long, n long")


@pytest.fixture(scope="session")
def repeated(spark):
    """Null and repeated ids."""
    return spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (None, None), (2, "a  b")], "doc_id long, text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
