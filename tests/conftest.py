import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("SILTERRA_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from silterra.session import local_session, prepare

    s = local_session(cpus=4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture(scope="session")
def sf(request):
    return f"{DATA}/sf0.001"
