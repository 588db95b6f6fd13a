"""The driver's entry point imports without a session, and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


def test_import_needs_no_session():
    got = run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q))")
    assert got.returncode == 0 and int(got.stdout) > 40, got.stderr


def test_import_without_the_corpus_operators():
    hidden = "import sys; sys.modules['tallyvine.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())"
    got = run(hidden)
    assert got.returncode == 0, got.stderr
    assert not any(x.startswith("op") and x[2].isdigit() or x == "pipeline" for x in got.stdout.split())
