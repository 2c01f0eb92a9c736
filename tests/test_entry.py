"""The entry module without the optional operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root: str) -> set[str]:
    code = "import __spark_entry__ as e; print('\\n'.join(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {**os.environ, "PYTHONPATH": root}
    return set(subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split())


def test_entry_imports_without_the_optional_folder(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    left = names(str(tmp_path / "copy"))
    assert "enrich" in left and "pipeline" not in left and not any(n.startswith("op") and n[2:3].isdigit() for n in left)
