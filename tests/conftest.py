import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codequarry.session import local_session

    os.environ["CODEQUARRY_LOCAL_SHARED"] = str(tmp_path_factory.mktemp("shared"))
    os.environ.setdefault("CODEQUARRY_DRIVER_MEMORY", "4g")
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
