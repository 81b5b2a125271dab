import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from srcatlas.session import drop_stages, local_session, ship

    s = local_session(4, **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    drop_stages()
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
