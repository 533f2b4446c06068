"""The entry module loads wherever the package does."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from casewright.plans.catalog import QUERIES

REPO = Path(__file__).resolve().parent.parent


def test_import_needs_no_spark_installation(tmp_path):
    """Neither a jar nor a JVM is touched: pyspark's own folder is pretended to be elsewhere."""
    code = (
        f"import pyspark; pyspark.__file__ = {str(tmp_path / 'pyspark' / '__init__.py')!r};"
        "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n_queries, n_oracles = map(int, done.stdout.split())
    assert n_queries >= n_oracles > 90


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_import_without_the_optional_folders(tmp_path, also):
    """Without the optional subpackage, and with or without the pipeline, every other query is there."""
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *also)
    copy = shutil.copytree(REPO, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e; print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert set(done.stdout.split()) == set(QUERIES)


def test_other_import_errors_stay_errors(tmp_path):
    """A broken operator is not taken for an absent folder."""
    copy = shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    (copy / "casewright" / "llm").mkdir()
    (copy / "casewright" / "llm" / "__init__.py").touch()
    (copy / "casewright" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, timeout=120
    )
    assert "no_such_module" in done.stderr
