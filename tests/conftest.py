"""One Spark session for all tests, with its shared folder set as a cluster would."""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyrun.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.log.level": "ERROR", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tallyrun-test-")},
    )
    session.sparkContext.setCheckpointDir(session.conf.get("spark.checkpoint.dir"))
    yield session
    session.stop()
