"""The driver's entry points, with or without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("helixframe.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= set(names)
"""


def run(code: str) -> None:
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_imports_without_corpus_operators():
    run(BLOCKED)


def test_imports():
    run("import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())")
