from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture()
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [
            (r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "a")), len(r[1]) if r[1] is not None else None) for r in rows
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
