"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tapewell.session import local_session

    session = local_session(4, "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con
