"""Folders that operators write to are the application's own and go with it."""

import os
import subprocess
import sys
import time

from tests.conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from linkweave.operators.components import connected_components
from linkweave.runtime import checkpoint
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
pairs = checkpoint(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
assert connected_components(pairs).where("component = 1").count() == 3
import os
assert os.listdir({folder!r})
{end}
"""


def test_checkpoints_go_with_the_application(tmp_path):
    for end, code in (("", 0), ("raise SystemExit(3)", 3)):
        folder = str(tmp_path / f"shared{code}")
        os.mkdir(folder)
        done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=folder, end=end)], capture_output=True, timeout=120, check=False)
        assert done.returncode == code, done.stderr.decode()[-2000:]
        # the JVM ends a moment after Python
        for _ in range(60):
            if not os.listdir(folder):
                break
            time.sleep(0.5)
        assert os.listdir(folder) == []
