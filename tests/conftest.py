import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("LOOMLINE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from loomline.session import get_session

    session = get_session(cpus=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
