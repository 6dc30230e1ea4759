import pytest

SF_SMALL = "/root/testdata/sf0.001"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture
def documents(spark):
    """(id, text[, lang, source]) rows to a table of several partitions with a column too many."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(r[2:] + (None, None))[:2], len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)

    return make
