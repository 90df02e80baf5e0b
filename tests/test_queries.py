import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.oracle import DATA, check
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLE[name])


def test_entry_without_llm_still_lists_queries():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.ORACLE) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.MERGES))
def test_merges_keep_update_and_insert(spark, name):
    target, source, keys = catalog.MERGES[name]
    t, n = (f(spark, DATA).select(*keys).distinct() for f in (target, source))
    assert t.join(n, keys, "left_anti").count() and t.join(n, keys).count() and n.join(t, keys, "left_anti").count()


def test_without_the_training_operators(tmp_path):
    """Both folders and the pipeline gone, as the driver does it."""
    here = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(here, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(catalog.QUERIES), out.stderr
