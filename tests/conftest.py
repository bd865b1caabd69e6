import os

import pytest

os.environ.setdefault("BENCH_CPUS", "4")


@pytest.fixture(scope="session")
def spark():
    from headwater.session import local_session

    return local_session(4, "tests", "4g")
