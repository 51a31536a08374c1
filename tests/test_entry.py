"""The entry points work without the optional subpackage and pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_points_without_optional_parts(tmp_path):
    shutil.copytree(ROOT / "quillstone", tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries() and len(e.queries()) > 50\n"
        "assert set(e.oracle_sql()) <= set(e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quillstone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quillstone.llm" not in path.read_text()
