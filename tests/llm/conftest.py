import os

import pytest


@pytest.fixture(scope="session")
def sf():
    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    return base
