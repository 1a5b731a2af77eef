from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault(
    "PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false --driver-memory 8g pyspark-shell"
)


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import build_session

    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
