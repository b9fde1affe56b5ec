import pytest
from made_texts import prose


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    rows = [
        (1, prose(80, 1), "en", "a", 1, 0.5, 7),
        (2, prose(80, 1), "en", "a", 1, 0.5, 7),
        (2, prose(80, 1), "en", "a", 1, 0.5, 7),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, 0.1, 1),
        (5, " \n\t ", "de", "b", 4, 0.1, 1),
        (None, prose(70, 2), "de", "", 2, 0.2, 2),
        (6, prose(30_000, 3), "en", "a", 9, 0.3, 3),
        (7, "éàü 中文 text", "fr", "c", 9, 0.3, 3),
        (8, "word", "fr", "c", 4, 0.4, 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard int")


@pytest.fixture(scope="session")
def empty_docs(hard_docs):
    return hard_docs.limit(0)
