"""Without the training-data subpackage, its tests and its pipeline, the rest is whole."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e, pkgutil, importlib, voltaic
for m in pkgutil.walk_packages(voltaic.__path__, "voltaic."):
    importlib.import_module(m.name)
names = set(e.queries())
assert len(names) > 100 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
assert set(e.oracle_sql()) < names
"""


def run(folder: Path) -> None:
    subprocess.run([sys.executable, "-c", CODE], cwd=folder, check=True, env={"PATH": "/usr/bin:/bin"})


def copy(tmp_path: Path, *left_out: str) -> Path:
    shutil.copytree(REPO / "voltaic", tmp_path / "voltaic", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_the_rest_is_whole(tmp_path):
    run(copy(tmp_path, "llm"))


def test_a_library_that_only_the_subpackage_needs_may_lack(tmp_path):
    folder = copy(tmp_path)
    shutil.copy(REPO / "corpus_pipeline.py", folder)
    (folder / "zstandard.py").write_text("raise ImportError('not here')\n")
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'op1_token_output' not in e.queries() and len(e.queries()) > 100"], cwd=folder, check=True)


def test_nothing_else_imports_the_subpackage():
    others = [p for p in (REPO / "voltaic").rglob("*.py") if "llm" not in p.parts]
    assert not [p for p in others if "llm" in p.read_text()]
