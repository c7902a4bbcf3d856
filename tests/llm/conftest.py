import pytest

from wireloom.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch long, score double, uid string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names the operators also use."""
    prepare(spark)

    def make(rows):
        full = [(i, t, lang, "s", len(t) if t is not None else None, 7, 0.25, "u") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make
