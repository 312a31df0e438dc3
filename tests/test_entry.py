"""The driver's entry points without a session."""

from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT


def test_names_and_sql_need_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
