import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from lumenquarry.operators.retrieval import dense_topk
from lumenquarry.session import ship_package
ship_package(spark), ship_package(spark)
v = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")
assert dense_topk(v.withColumnRenamed("doc_id", "query_id"), v).count() == 1
"""


def test_workers_find_the_package_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, env=env, check=True, timeout=120)
