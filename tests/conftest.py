import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=os.environ.get("TEST_CPUS", "8"))
    session.sparkContext.setLogLevel("ERROR")
    # TEST_CONF="key=value;key=value" runs the same tests under other settings, e.g. without adaptive execution.
    for setting in filter(None, os.environ.get("TEST_CONF", "").split(";")):
        session.conf.set(*setting.split("=", 1))
    yield session
    session.stop()
