"""The driver's entry module in a checkout without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAID = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q); print(sum(k[:2] == 'op' and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize(("lost", "wanted"), [(["fathom/llm"], "0 False"), (["fathom/llm", "corpus_pipeline.py"], "0 False")])
def test_queries_without_the_optional_parts(tmp_path, lost, wanted):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in lost:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SAID], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)
    assert done.stdout.split("\n")[-2] == wanted, done.stderr
