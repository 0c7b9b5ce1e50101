import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        T.StructField("size", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table with extra columns."""

    def make(rows, parts=3):
        full = []
        for row in rows:
            doc, text, lang, source = (*row, *(None,) * (4 - len(row)))
            full.append((doc, text, lang, source, len(text or ""), 5, "x", 0.5))
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make
