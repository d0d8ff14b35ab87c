import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, did string, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and extra columns with the operators' own names."""
    copy = "Some words that come again and again, in one long line that is well over a hundred bytes long, as it should be. "
    copy += "And another sentence with ten more words follows it here now. "
    rows = [
        (1, copy * 2, "en", "a", 1), (2, copy, "en", "a", 1), (2, copy, "en", "a", 1), (2, "other text of the same id", "de", None, 1),
        (3, None, None, None, None), (4, "", "en", "b", 0), (5, "   \t\n ", "en", "b", 5), (None, copy, "en", "b", 1), (None, None, "en", "b", 1),
        (6, "Émile wrote to émile@example.org and jo@example.org or +1 (988) 555-2485 from 10.0.0.1", "fr", "c", 1), (7, "word " * 30000, "en", "c", 1), (8, "one", "en", "c", 1),
    ]
    return spark.createDataFrame([(*r, "k", "d", "h") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
