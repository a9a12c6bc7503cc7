"""A plain local session, from another folder and without any settings of the machine."""

import os
import subprocess
import sys

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from cilens import plans
from cilens.session import scratch_path
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert scratch_path(spark, "a").split("/cilens/")[0] == scratch_path(spark, "b").split("/cilens/")[0]
print("rows", plans.QUERIES["l23_python_symbols"](spark, {folder!r}).count(), plans.QUERIES["j1_call_edges"](spark, {folder!r}).count())
"""


def test_queries_run_on_a_plain_session(tmp_path):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=repo, folder=folder)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 434 136" in done.stdout
