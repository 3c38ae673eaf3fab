"""The entry module with and without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left_out", [(), ("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_imports(tmp_path, left_out):
    ignore = shutil.ignore_patterns("__pycache__", ".git", *left_out)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    assert run.returncode == 0, run.stderr
    total, own, known = run.stdout.split()
    assert int(total) > 140 and known == "True"
    present = not left_out and os.path.exists(os.path.join(ROOT, "graphloom", "llm"))
    assert (int(own) > 0) == present
