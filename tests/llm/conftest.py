import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with a column that clashes with what operators add."""

    def build(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("n_lines", "ids", "copies", "class_id", "row_id", "score", "kept"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build
