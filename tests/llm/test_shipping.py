"""All corpus queries where the workers cannot import this package: only the driver has its folder on the path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[3]).getOrCreate())

def importable(_):
    try:
        import webgrain
    except ModuleNotFoundError:
        return [0]
    return [1]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [0]
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
found = entry.queries()
for name in sorted(n for n in found if n.startswith("op") or n == "pipeline"):
    print(name, len(found[name](spark, sys.argv[2]).collect()), flush=True)
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_workers_without_the_package(tmp_path):
    (tmp_path / "run.py").write_text(SCRIPT)
    (tmp_path / "shared").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).parents[2])
    done = subprocess.run(
        [sys.executable, "run.py", repo, FOLDER, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    ran = [line.split()[0] for line in done.stdout.splitlines()]
    assert len([n for n in ran if n.startswith("op")]) == 13 and "pipeline" in ran
