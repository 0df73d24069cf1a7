import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from slatework.session import local_session
    s = local_session(shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from slatework.sources.fixtures import Fixtures
    return Fixtures(spark, SMALL)
