from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracegrove.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", shuffle_partitions=4, memory="4g")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
