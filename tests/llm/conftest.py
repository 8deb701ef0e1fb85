import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import tables  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return tables.documents(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return tables.nothing(spark)
