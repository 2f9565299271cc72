import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tissuelake.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = local_session(4, 4, "4g", **{"spark.checkpoint.dir": str(folder / "shared"), "spark.sql.warehouse.dir": str(folder / "warehouse")})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
