import pytest


@pytest.fixture
def table_of(spark, tmp_path):
    """Rows as a stored table, which is what the operators take."""

    def make(rows, schema, name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(2).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)

    return make
