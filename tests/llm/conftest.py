import pytest

from tests.conftest import spark  # noqa: F401


@pytest.fixture()
def awkward(spark):  # noqa: F811
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    long = "word " * 40_000 + "é" * 3000
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A B C d e f g", None), (3, None, "n"), (None, "null id text with some words", "y"), (4, "", "e"), (5, " \n\t ", "b"), (6, long, "l"), (7, long, "l"), (8, "one", "s"), (-9, "one", "s")]
    df = spark.createDataFrame([(i, t, "en", s, s, s, 1.5, s) for i, t, s in rows], "doc_id long, text string, lang string, source string, hash string, row string, score double, n_chunks_removed string")
    return df
