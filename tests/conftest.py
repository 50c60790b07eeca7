import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracewright.runtime import session

    s = session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL
