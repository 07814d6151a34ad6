"""A local session and helpers for the tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from mnemospark.session import session

    s = session("local[4]", shuffle_partitions=4, memory="4g", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()
