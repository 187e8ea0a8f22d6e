import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table of the given texts, ids from 0."""

    def make(texts, schema=DOCS, **columns):
        rows = [(k, x, columns.get("lang", ["en"] * len(texts))[k], columns.get("source", ["s"] * len(texts))[k], len(x or "")) for k, x in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make
