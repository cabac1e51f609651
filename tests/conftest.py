import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sparkattest.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over a one-row table built from keyword values."""
    from pyspark.sql import functions as F

    def run(expr, schema="x string", *values):
        row = spark.createDataFrame([tuple(values) if values else ("",)], schema)
        return row.select(expr.alias("v")).first()["v"]

    run.F = F
    return run
