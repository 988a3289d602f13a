"""The entry file without the folders of training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k == 'pipeline' or k[:2] == 'op'))"


def _names(folder):
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True, timeout=120)
    return out.stdout.split(" ", 2)


def test_entry_without_parts(tmp_path):
    shutil.copytree(os.path.join(ROOT, "airrline"), tmp_path / "airrline", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if os.path.isdir(tmp_path / "airrline" / "llm"):
        assert "'pipeline'" not in _names(tmp_path)[2] and "'op2_bpe'" in _names(tmp_path)[2]
        shutil.rmtree(tmp_path / "airrline" / "llm")
    n, sql, ops = _names(tmp_path)
    assert int(n) == int(sql) > 40 and ops.strip() == "[]"
