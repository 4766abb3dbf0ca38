import os
import signal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weir.session import local_session  # noqa: E402

#: Seconds that a test may take.
LIMIT = 240


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(autouse=True)
def time_limit():
    def stop(*_):
        raise TimeoutError(f"a test took over {LIMIT} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
