"""The library stands without its optional subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "trackmill", tmp_path / "trackmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql = map(int, said.stdout.split())
    assert n > 60 and sql >= n - 1


def test_nothing_else_imports_it():
    for path in (ROOT / "trackmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
