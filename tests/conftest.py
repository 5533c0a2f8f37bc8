import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    folder = TESTDATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test data")
    return str(folder)
