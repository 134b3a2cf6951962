import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows (id, text) as a documents table; a further column has a name that the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows, **columns):
        full = [(i, t, columns.get("lang", "en"), f"s{(i or 0) % 12}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).withColumn("id", F.lit("clash")).withColumn("node", F.lit(1))

    return make
