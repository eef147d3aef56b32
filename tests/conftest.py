import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PLOTWEAVE_DRIVER_MEMORY", "6g")

from plotweave.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def duck():
    from tools.check import connect

    return connect(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
