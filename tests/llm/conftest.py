import pytest

SHARED = "the quick brown fox jumps over the lazy dog while nobody looks at the old stone bridge near the mill. "


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (0, "", "en", "a", 1), (1, None, "en", "a", 1), (2, long, None, "b", 1), (3, SHARED * 8, "en", None, None),
        (4, SHARED * 8, "en", "a", 1), (4, SHARED * 8, "en", "a", 1), (None, "no id here. " * 30, "de", "b", 2), (6, "   \n \t ", "de", "b", 2),
        (7, "one two", "fr", "b", 2), (8, "é ü 😀 " * 40, "fr", "b", 2), (9, "a\x1cb c " * 60, "es", "c", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
