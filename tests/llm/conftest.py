import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(*texts, **more):
        rows = [(i, t, "en", "a" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
