"""Workers get the package from the session, wherever the driver was started."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {repo!r})
from tallyrun.session import build
from tallyrun.functions.clock import file_stem
spark = build("elsewhere", "local[1]", **{{"spark.ui.enabled": "false", "spark.log.level": "ERROR"}})
def run(batches):
    import tallyrun.sources.performance
    yield from batches
print("rows", spark.range(3).mapInArrow(run, "id long").count())
"""


def test_workers_import_the_package_from_elsewhere(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
