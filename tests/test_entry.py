"""The driver's entry points without the optional subpackage, and with one that fails inside."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def load(folder, after=""):
    return subprocess.run([sys.executable, "-c", f"import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql())); {after}"], cwd=folder, capture_output=True, text=True)


def test_without_the_subpackage_and_with_a_broken_one(tmp_path):
    shutil.copytree(ROOT / "gridpoint", tmp_path / "gridpoint", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = load(tmp_path, "assert not any(n.startswith('op') for n in e.queries())")
    assert found.returncode == 0, found.stderr
    (tmp_path / "gridpoint/llm").mkdir()
    (tmp_path / "gridpoint/llm/__init__.py").touch()
    (tmp_path / "gridpoint/llm/registry.py").write_text("import no_such_module_anywhere\n")
    assert "no_such_module_anywhere" in load(tmp_path).stderr
