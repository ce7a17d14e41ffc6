import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.runtime import local_session

    return local_session(4, "tests", "3g")


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column over literal rows: values([(...), ...], 'a string, ...', column) -> list of results."""

    def run(rows, schema, *columns):
        out = spark.createDataFrame(rows, schema).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()
        return [r[0] if len(columns) == 1 else tuple(r) for r in out]

    return run
