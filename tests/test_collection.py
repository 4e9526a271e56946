"""All test modules of the repository are found in one run, also those of one name in several folders."""

import subprocess
import sys
from pathlib import Path

TESTS = Path(__file__).resolve().parent


def test_every_module_is_collected():
    run = [sys.executable, "-m", "pytest", str(TESTS), "--collect-only", "-q", "-p", "no:cacheprovider"]
    done = subprocess.run(run, cwd=TESTS.parent, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]
    found = {line.split("::")[0] for line in done.stdout.splitlines() if "::" in line}
    assert found == {str(p.relative_to(TESTS.parent)) for p in TESTS.rglob("test_*.py")}
