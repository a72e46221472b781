import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source); with a column that clashes with inner names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("rank", "size", "key", "length", "h", "rep", "base", "score", "id", "_text"):
            df = df.withColumn(name, df.lang)
        return df

    return make


EDGE = [(None, None), (None, "only words here"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "ONE"), (6, "é😀 ß " * 50)]


@pytest.fixture
def edge_rows():
    return list(EDGE)
