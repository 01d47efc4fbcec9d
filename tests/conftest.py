import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomwise.session import local_session, shared_dir

    s = local_session(8, 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    shared_dir(s)
    return s
