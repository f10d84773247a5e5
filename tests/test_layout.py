"""The engine without the training-data subpackage: the entry imports and registers the other queries."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("path", ["", str(ROOT)])
@pytest.mark.parametrize("gone", [["krathong/llm", "tests/llm"], ["krathong/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone, path):
    """Also where another tree with all of it is on the path."""
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for g in gone:
        (shutil.rmtree if (there / g).is_dir() else Path.unlink)(there / g) if (there / g).exists() else None
    code = "import __spark_entry__ as e; import bench; q = e.queries(); assert 'sentence_pipeline' in q and set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"
    env = {**os.environ, "PYTHONPATH": path}
    out = subprocess.run([sys.executable, "-c", code], cwd=there, env=env, capture_output=True, text=True, timeout=120, check=True).stdout
    assert ("op4_blob_ledger" in out) == ("krathong/llm" not in gone and (ROOT / "krathong/llm").exists())
    assert ("pipeline" in out) == (not gone and (ROOT / "corpus_pipeline.py").exists())
