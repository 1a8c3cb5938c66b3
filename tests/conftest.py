import os

import pytest

from ledgerloom.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no input tables")
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a single value."""
    from pyspark.sql import functions as F

    def run(value, *columns, name="v"):
        df = spark.createDataFrame([(value,)], f"{name} STRING")
        row = df.select(*[c(F.col(name)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run
