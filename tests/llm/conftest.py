import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, sources=None, langs=None, first=0):
        n = len(texts)
        return spark.createDataFrame(
            [(first + i, t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t) if t is not None else None) for i, t in enumerate(texts)], DOCUMENTS
        )

    return make
