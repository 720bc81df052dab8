import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


@pytest.fixture(scope="session")
def parity_data():
    """Large enough that every query has rows."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("test data not present")
    return path


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("test data not present")
    return DATA
