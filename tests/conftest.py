import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from panelgrid.session import build_session
    s = build_session("tests", "local[*]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def crowded(monkeypatch):
    """Few values may be sorted together, so every level of digits is used."""
    from panelgrid.operators import radix
    monkeypatch.setattr(radix, "CROWDED", 2)
