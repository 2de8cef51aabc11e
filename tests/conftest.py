import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from uttermark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate Column expressions over rows and return plain tuples."""

    def run(schema, rows, *columns):
        return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]

    return run
