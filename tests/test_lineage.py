"""The shared folder in a session that names none, which only a process of its own can be."""

import os
import subprocess
import sys

SESSION = """
from pyspark.sql import SparkSession
from wayline.operators import lineage

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = lineage.shared_root(spark), lineage.shared_root(spark)
assert two.removeprefix("file:").startswith(one), (one, two)
assert lineage.cut(spark.range(3)).count() == 3
spark.range(2).write.parquet(lineage.scratch(spark, "rows"))
print("folder", one)
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    run = subprocess.run([sys.executable, "-c", SESSION], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    folder = run.stdout.split("folder ")[1].strip()
    assert not os.path.exists(folder)
