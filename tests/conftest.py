import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from millrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "millrace-tests", master="local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"},
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip(f"no test data at {path}")
    return path


@pytest.fixture
def raw(spark):
    """A raw text table from rows: ``raw("a b", ("1", None), ...)``."""

    def make(columns, *rows):
        schema = ", ".join(f"{c} STRING" for c in columns.split())
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)

    return make
