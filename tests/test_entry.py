"""The driver's contract, with and without the subpackage that may be absent."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_core_does_not_import_llm():
    code = "import sys; sys.modules['tidefold.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'kv_state' in e.queries() and 'pipeline' not in e.queries(); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    for path in (ROOT / "tidefold").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
