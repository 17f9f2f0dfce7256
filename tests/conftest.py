import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from orgloom.session import local_session

    session = local_session("tests", cpus=8, spark__driver__memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
