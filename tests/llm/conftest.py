import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from texts import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null keys, repeated rows, extra columns whose names clash with results and internals."""
    schema = SCHEMA + ", score double, content string, `class` string, `a.b` int, Size int"
    row = (1, "some words that are here more than five times over", "en", None, 0.5, "c", "k", 1, 2)
    return spark.createDataFrame([row, row, (None, *row[1:]), (2, None, None, None, None, None, None, None, None)], schema)
