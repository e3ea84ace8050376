"""The whole suite is collected: every registered query is held against its oracle."""

import subprocess
import sys
from pathlib import Path

from duecheck.plans.queries import queries

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_is_collected():
    run = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"],
        cwd=ROOT, capture_output=True, text=True,
    )
    assert run.returncode == 0, run.stdout[-2000:]
    for name in queries():
        assert f"tests/test_oracle.py::test_query[{name}]" in run.stdout
