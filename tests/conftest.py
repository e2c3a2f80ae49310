import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqflow.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores="4", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def smoke_dir():
    if not os.path.isdir(SMOKE):
        pytest.skip("no test tables")
    return SMOKE
