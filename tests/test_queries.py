"""Every query with SQL gives the SQL's rows; every other query runs."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.comparing import tuples

SLOW = {"regression_summary", "lr_test_table", "full_panel"}
CORE = {n for m in ("tapewell.queries.general", "tapewell.queries.reference") for n in __import__(m, fromlist=["QUERIES"]).QUERIES}


def test_entry_gives_rows(spark, folder):
    assert entry.entry(spark).count() > 0


def test_sql_has_only_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_query_matches_sql(spark, folder, duck, name):
    ours = entry.queries()[name](spark, folder).toPandas()
    theirs = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert tuples(ours) == tuples(theirs)


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql()) - SLOW))
def test_query_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() >= 0


def test_full_panel_has_its_columns(spark, folder):
    from tapewell.operators.panel import PanelConfig
    from tapewell.plans.pipelines import panel_columns

    panel = entry.queries()["full_panel"](spark, folder)
    assert panel.columns == [c for c in panel_columns(PanelConfig(alternatives=("bertweet", "fintwit"))) if c in panel.columns]
    assert len(panel.columns) == 133


def test_without_llm_the_rest_stands(tmp_path):
    """Nothing outside the subpackage imports it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    hidden = tmp_path / "copy"
    import shutil

    shutil.copytree(root, hidden, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "tests"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(k for k in e.queries() if k[0] == 'p' and k[1].isdigit()))"], cwd=hidden, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert "p4_found" in said.stdout and "p1_found" not in said.stdout
