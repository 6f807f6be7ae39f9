import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    from corpusloom.session import local_session

    s = local_session(cores=4, shuffle=4, name="tests", memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
