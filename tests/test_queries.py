"""Every registered query of the core against its SQL on DuckDB, over the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

from skyframe.plans import queries as core


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, connection, small, name):
    assert oracle.compare(spark, connection, core.QUERIES[name], core.SQL[name], small) is None


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, small, name):
    rows = core.QUERIES[name](spark, small)
    assert rows.count() > 0 and rows.columns


def test_report_counts_what_was_found(spark, small):
    total = core.QUERIES["np_report"](spark, small).groupBy().sum().first()
    found = core.QUERIES["conjunctions"](spark, small).count()
    assert total["sum(windows)"] == total["sum(kept_windows)"] + total["sum(fast_rejected)"]
    assert total["sum(hits)"] + total["sum(end_hits)"] + total["sum(begin_hits)"] >= found


def test_entry(spark):
    import __spark_entry__

    assert set(core.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_folders(tmp_path):
    """A copy without both folders and the pipeline imports, and has the core's queries."""
    root = Path(__file__).resolve().parents[1]
    leave = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=leave)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(core.QUERIES)), str(len(core.SQL)), "False"]
