import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_results_survive_task_retries():
    """A separate local[4,3] session: even-numbered tasks fail on their first attempt."""
    out = subprocess.run([sys.executable, os.path.join(HERE, "scripts", "retry_check.py"), "/root/testdata/sf0.001"],
                         capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("OK"), out.stdout[-2000:] + out.stderr[-3000:]
