import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A table on disk, as operators read them, from rows and a schema."""
    import uuid

    from plotweave.session import shared_folder

    def make(rows, schema):
        path = f"{shared_folder(spark)}/given-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make
