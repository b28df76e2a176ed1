import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


# Started here: column expressions at module level need a session.
SESSION = local_session(cores=8, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf():
    return SF
