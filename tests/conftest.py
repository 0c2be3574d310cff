import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evidary.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "evidary-tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture()
def values(spark):
    """Evaluate one expression over rows: ``values(rows, schema, column)``."""

    def run(rows, schema, column):
        return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]

    return run
