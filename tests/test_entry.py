"""The entry point with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LLM = os.path.join("brindle", "llm")


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_optional_parts(tmp_path, pipeline):
    gone = {"__pycache__", ".git", *(() if pipeline else ("corpus_pipeline.py",))}
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=lambda d, names: [n for n in names if n in gone or os.path.relpath(os.path.join(d, n), REPO) in (LLM, "tests")])
    code = """
import __spark_entry__ as e
from brindle.session import session
assert set(e.oracle_sql()) <= set(e.queries()) and all(n.startswith("q_") for n in e.queries())
assert e.entry(session("local[2]", spark_ui_enabled="false")).count() == 20
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_every_query_is_there():
    import __spark_entry__ as e

    assert "q_flagship" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
