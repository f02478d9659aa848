"""Executors import the package although only the driver knows where it is."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from tallybench.operators.neighbours import knn_graph
df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "row_id long, features array<double>")
assert knn_graph(df, "row_id", 2).count() == 18
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, check=True, timeout=300)
