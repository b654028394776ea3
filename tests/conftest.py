import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from hourwise.session import checkpoint_dir, local_session

    s = local_session(cores="*", shuffle_partitions=8, app="hourwise-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sf001():
    return os.path.join(TESTDATA, "sf0.01")


@pytest.fixture(scope="session")
def sf0001():
    return os.path.join(TESTDATA, "sf0.001")


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
