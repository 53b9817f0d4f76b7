import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from crateloom.session import build_session
    s = build_session("tests", cores=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
