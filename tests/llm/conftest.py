import pytest


@pytest.fixture
def stored(spark, tmp_path):
    """Write rows as a Parquet table and read it back."""

    def make(rows, schema, name="documents"):
        path = f"{tmp_path}/{name}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make
