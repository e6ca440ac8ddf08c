import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (id, text) pairs."""

    def make(rows, **extra):
        data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(data, DOCS)

    return make


def near(text, *cuts):
    """text without the words at the given places."""
    return " ".join(w for i, w in enumerate(text.split()) if i not in cuts)
