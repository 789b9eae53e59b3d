import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from tracewell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle_partitions="4")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """(source, line_no, template) from one list of templates per source."""

    def make(*texts):
        rows = [(f"s{k}", i, t) for k, series in enumerate(texts) for i, t in enumerate(series)]
        return spark.createDataFrame(rows, "source string, line_no long, template string")

    return make


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
