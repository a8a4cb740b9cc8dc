import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from xgspark.session import build_session, checkpoint_dir

    s = build_session("local[4]", "xgspark-tests", 8)
    checkpoint_dir(s)  # unset in tests: a local folder of our own
    yield s
    s.stop()
