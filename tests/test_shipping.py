"""The entry works from a folder that does not hold the package."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys, importlib.util
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").config(
    "spark.driver.memory", "1g").config("spark.driver.host", "127.0.0.1").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
print("ROWS", len(entry.queries()["estimate_p_values"](s, sys.argv[3]).collect()))
"""


def test_entry_from_another_folder(tmp_path, sf):
    # nothing of the session of the other tests goes to the child
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not re.match("SPARK_|PYSPARK_", k)}
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run([sys.executable, "-c", CODE, ROOT, f"file://{tmp_path}/shared", sf], cwd=tmp_path,
                          env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, f"{done.stdout[-1000:]}\n{done.stderr[:3000]}\n...\n{done.stderr[-3000:]}"
