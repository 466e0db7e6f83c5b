import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, T.StructType.fromDDL(DOCUMENTS))

    return make
