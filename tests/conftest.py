import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from recallgrid.session import build_session  # noqa: E402
from recallgrid.sources.views import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", "local[4]", 4, "4g")


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)
