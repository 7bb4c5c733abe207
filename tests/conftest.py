import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    s = local_session(4, "textloom-tests", "4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
