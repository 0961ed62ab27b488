from __future__ import annotations

import pytest



@pytest.fixture(scope="session")
def docs_frame(spark):
    """Rows of documents with a column named as ones that operators use inside."""

    def make(rows, *more):
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(m, T.StringType()) for m in more)])
        return spark.createDataFrame([tuple(r) + ("x",) * (len(schema) - len(r)) for r in rows], schema)

    return make
