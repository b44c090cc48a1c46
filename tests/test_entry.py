"""The entry points import without a session, and without the pipeline's subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def count(folder: Path) -> list[int]:
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()[-2:]]


def test_imports_without_a_session():
    queries, sql = count(ROOT)
    assert queries >= sql >= 70


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "graphloom"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    queries, sql = count(tmp_path)
    assert queries == sql >= 70
