"""The entry points with and without the subpackage of pipeline operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CALL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('q_') for n in q))"


@pytest.mark.parametrize("gone", [["tidemark/llm", "tests/llm"], ["tidemark/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_pipeline_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", CALL], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, own = map(int, out.stdout.split()[-2:])
    assert total == own > 50
