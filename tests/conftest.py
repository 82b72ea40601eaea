import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quarrylight.session import get_session

    session = get_session("tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()
