"""The library without its corpus operators: it imports, and none of its modules names them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for gone in ("veridict/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 80
    for path in (copy / "veridict").rglob("*.py"):
        assert "veridict.llm" not in path.read_text(encoding="utf-8")
