import pytest


@pytest.fixture
def docs(spark):
    """Build a documents table of (doc_id, text) rows with further columns whose names may clash."""

    def build(rows):
        return spark.createDataFrame(
            [(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, n long, id string, line string"
            .replace("n long", "n string").replace("id string", "id int"))

    return build
