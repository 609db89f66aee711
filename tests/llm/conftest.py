import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", "x"),
        (2, "Alpha, beta gamma delta epsilon zeta eta theta!", "en", "b", "x"),
        (2, "Alpha, beta gamma delta epsilon zeta eta theta!", "en", "b", "x"),
        (3, None, None, None, None),
        (4, "", "de", "a", "y"),
        (None, "mit license mit license", None, "c", "y"),
        (5, "wort " * 30_000, "de", "a", "z"),
        (6, "12 34 !!", "en", "b", None),
        (7, "das ist ein Satz über Öl", "de", "c", "z"),
        (8, "x" * 50_000, "en", None, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")
