"""The entry module, with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_without_the_subpackage(tmp_path):
    """A copy without the operators for training data imports, and has the queries of the engine."""
    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from tessera.queries import queries; assert set(e.queries()) == set(queries()) == set(e.oracle_sql()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 90, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (REPO / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tessera.llm" not in path.read_text(), path
