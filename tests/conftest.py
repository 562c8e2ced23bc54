import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()
