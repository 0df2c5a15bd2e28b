"""Workers need no copy of the package: the driver may start anywhere."""

import os
import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {shared!r})
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as entry
print("rows", len(entry.entry(spark).collect()))
folder = "/root/testdata/sf0.001"
for name in ("encode", "knn_join_blocks", "stratify_farthest", "mine_triplets", "respond", "encode_with_model"):
    print(name, entry.queries()[name](spark, folder).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_runs_from_another_folder_and_uses_the_named_shared_folder(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT), shared=str(shared))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 500" in done.stdout and "False" not in done.stdout
    assert any(shared.rglob("*.parquet"))
