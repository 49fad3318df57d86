"""One local session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import builder

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = builder("tests", 4).master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.checkpoint.dir", f"{folder}/shared").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
