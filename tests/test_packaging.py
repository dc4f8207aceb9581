"""Python functions reach the workers from any working folder."""

import os
import subprocess
import sys

from tests.conftest import SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from quillspark.session import build_session
from quillspark.plans.registry import QUERIES
spark = build_session("away", "local[2]", spark__sql__shuffle__partitions=2, spark__ui__enabled="false")
print("rows", QUERIES["json_facts"](spark, {folder!r}).count())
print("rows", QUERIES["json_recovery"](spark, {folder!r}).filter("ok").count())
"""


def test_workers_find_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, folder=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0 and done.stdout.count("rows") == 2, done.stderr[-2000:]
