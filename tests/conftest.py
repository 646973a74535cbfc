import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import build_session

    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
