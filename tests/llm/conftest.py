import pytest

DOCS = "doc_id long, text string, source string, score string, n_lines string, id string"


@pytest.fixture
def docs(spark):
    """Makes a table of documents that also has columns with the names of result and working columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, s, "clash", "clash", "clash") for i, t, s in ((*r, None)[:3] for r in rows)], DOCS).repartition(3)

    return make
