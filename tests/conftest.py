import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rostra.session import build_session

    s = build_session("local[4]", 4, app="rostra-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="rostra-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="rostra-test-")
