import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, row string, cells string, ids string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text[, source[, lang]]), with extra columns whose names operators use inside."""

    def make(*rows):
        full = []
        for r in rows:
            doc_id, text, source, lang = (*r, *(None,) * (4 - len(r)))
            full.append((doc_id, text, lang, source, None, 1, "x", "y", "z"))
        return spark.createDataFrame(full, DOCS)

    return make
