import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The fixtures are small: fewer tasks make the many short jobs quicker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
