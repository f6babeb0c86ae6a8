"""The library without its training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_import_without_training_data_part(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    if not with_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "search_bm25_batch" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
