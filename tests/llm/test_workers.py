"""Executors need no copy of the package: all queries run in a session whose workers can't import it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def importable(_):
    import importlib.util
    yield importlib.util.find_spec("rankmill") is not None

assert not any(spark.sparkContext.parallelize(range(4), 4).mapPartitions(importable).collect())
sys.path.insert(0, sys.argv[1])
from rankmill.llm.queries import QUERIES
for name, query in QUERIES.items():
    query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
"""


def test_workers_without_the_package(tmp_path, sf_dir):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != repo]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(others)}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(script), repo, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ran op") == 13
