import pytest


@pytest.fixture
def texts(spark):
    """A table of documents with every oddity: nulls, empty, repeated rows and ids, ties, clashing extra columns."""

    def make(rows):
        clash = ", key string, g long, at int, n long, size long, block int, node long, rank int, _key string"
        return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, 5, 6, 7, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + clash)

    return make
