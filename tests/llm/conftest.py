import pytest


@pytest.fixture
def docs(spark):
    """Rows with a clashing extra column, from (doc_id, text, lang, source) tuples."""

    def make(rows, score="x"):
        full = [(*r, "clash", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score string, n long")

    return make
