import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) or longer tuples."""

    def make(rows, extra=()):
        full = [(r[0], r[1], *(r[2:] or ("en", "s0", len(r[1] or "")))) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
