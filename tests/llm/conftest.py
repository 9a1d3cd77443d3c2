import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names an operator may use itself."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
        for name in ("row", "key", "words", "score", "runs", "group", "component_id", "w", "n", "found"):
            df = df.withColumn(name, F.lit(name))
        return df

    return make
