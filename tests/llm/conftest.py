import pytest


@pytest.fixture()
def docs_of(spark):
    """Documents from texts, with a null id's neighbour columns that clash with names used inside the operators."""

    def make(texts, start=0):
        rows = [(start + k, t, 1, "x", "y") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, key int, score string, size string").repartition(3)

    return make
