import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, with ids from 0; a pair gives the id too."""

    def make(*texts, extra: str = ""):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", None) + ((7,) if extra else ()) for i, t in rows]
        return spark.createDataFrame(rows, DOCS + (f", {extra} int" if extra else "")).repartition(3)

    return make
