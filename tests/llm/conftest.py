import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

DOC = "doc_id long, text string"


@pytest.fixture()
def docs(spark):
    """Rows to a documents table; ``extra`` adds columns whose names clash."""
    def make(rows, extra=False):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, DOC)
        if extra:
            for c in ("kept", "hits", "n_words", "secrets", "component_id", "shard", "_text", "n_tokens", "_hash", "fp"):
                df = df.withColumn(c, F.lit("x"))
        return df
    return make
