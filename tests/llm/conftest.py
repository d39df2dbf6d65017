import pytest


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text), ...], extra columns as constants) with repeated rows as given."""
    def build(rows, **extra):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        return df.withColumns({k: F.lit(v) for k, v in extra.items()}) if extra else df
    return build


@pytest.fixture
def table(spark):
    def load(name, sf="sf0.001"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
    return load
