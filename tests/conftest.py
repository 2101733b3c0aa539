import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyhouse.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def frame(spark):
    """Small literal table: frame("a int, b string", (1, "x"), ...)."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
