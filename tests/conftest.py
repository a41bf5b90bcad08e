"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quartzgate import session

    s = session.local(cpus=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
