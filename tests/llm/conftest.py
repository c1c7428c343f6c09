import pytest

LONG = "word " * 30_000
TEXTS = [
    (1, "Alpha beta gamma delta. Mail me@ex.org now"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "Alpha beta gamma delta. Mail me@ex.org now"),
    (5, "Alpha beta gamma delta. Mail me@ex.org now"),
    (None, "lone text é😀 \x00 ok"),
    (7, " \t\n "),
    (8, "ÀÉÎ ç 中文 naïve é İstanbul 's 'll 12 345 +-*/"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    rows = [(d, t, "en", f"s{i}", len(t or ""), i, "x", None) for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, word string, label int")


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 3 else 0, int(i % 7 == 0)) for i in range(1, 400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.limit(0)
