import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Rows as a documents table; missing columns are null."""

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def texts(make):
    """(doc_id, text) pairs as documents that also have columns with clashing names."""

    def build(pairs, source=lambda i: f"s{i % 3}"):
        rows = [(i, t, "en", source(n), 0, "x", 1) for n, (i, t) in enumerate(pairs)]
        return make(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, `size` int")

    return build
