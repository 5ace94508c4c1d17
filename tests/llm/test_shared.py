import os
import subprocess
import sys

SESSION = """
from pyspark.sql import SparkSession
from wayline.llm import shared

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared.staged(spark.range(3), "rows").count() == 3
assert shared.staged(spark.range(4), "rows").checkpoint().count() == 4
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    run = subprocess.run([sys.executable, "-c", SESSION], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
