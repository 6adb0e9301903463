import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from emberline.session import HOT_ROWS_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def chunked(spark):
    """Limits so low that every series is cut."""
    spark.conf.set(HOT_ROWS_KEY, "7")
    yield
    spark.conf.unset(HOT_ROWS_KEY)
