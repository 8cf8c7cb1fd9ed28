"""Small tables of the ten problems."""

import pytest


@pytest.fixture()
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
