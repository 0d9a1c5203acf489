import pytest
from odd_rows import ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, repeated rows, a null id."""
    return docs(*ODD)


@pytest.fixture
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"
