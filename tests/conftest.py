import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

from reelframe.session import local_session  # noqa: E402

DATA = os.environ.get("REELFRAME_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 4, "8g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def con():
    from tests.oracle import connect

    return connect(DATA)
