import pytest

LONG = "word " * 30_000
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string, part string, kept string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, "x", "y", "z", "w") for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and very long texts, repeated rows and ids."""
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "one two three"), (5, "one two three"), (5, "another text"), (None, "no id"), (None, "no id"), (6, "汉语 \U0001d11e café é \x01 <|endoftext|>"), (7, "x" * 200_000)]
    return docs_of(rows)
