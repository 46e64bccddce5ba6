import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanweave.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = ship(local_session("*", 8, "6g", "tests"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
