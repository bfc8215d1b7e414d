import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "pagelens-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate one column expression over one text."""

    def run(build, *values, schema="x string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame([tuple(values)], schema).select(build(F).alias("out")).first()["out"]

    return run
