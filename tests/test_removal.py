"""The rest works without the document operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_document_operators(tmp_path):
    shutil.copytree(ROOT / "cartolith", tmp_path / "cartolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'normalize_uint16' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_the_other_tests_load_without_document_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("cartolith", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=skip)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYTEST")} | {"PYTHONPATH": str(tmp_path)}
    run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0 and "error" not in run.stdout.lower(), run.stdout


def test_nothing_imports_the_document_operators():
    for path in (ROOT / "cartolith").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
