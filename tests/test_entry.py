"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(cwd):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, check=True, capture_output=True, text=True).stdout.split()


def test_library_stands_without_the_subpackage(tmp_path):
    rest = tmp_path / "repo"
    shutil.copytree(ROOT / "tagquarry", rest / "tagquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", rest)
    found = names(rest)
    assert "a1_extract_tags" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tagquarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8")


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
