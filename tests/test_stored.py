"""The folder for intermediate tables, with no setting of Spark's for it."""

import os
import subprocess
import sys

import pytest

from wayline.plans import stored

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
UNSET = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from wayline.plans.stored import discard, shared_dir, stored
kept = stored(spark.range(10), "kept")
assert kept.count() == 10 and shared_dir(spark) == spark.conf.get("wayline.shared.dir")
discard(kept)
import __spark_entry__
found = __spark_entry__.queries()
assert found["J7_nearest_photos"](spark, "/root/testdata/sf0.001").count() > 0
if "op2_sharding" in found:
    assert found["op2_sharding"](spark, "/root/testdata/sf0.001").count() > 0
print("ended well")
"""


def test_without_the_setting_of_spark(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO}
    said = subprocess.run([sys.executable, "-c", UNSET], env=env, cwd=REPO, capture_output=True, text=True, timeout=300)
    assert "ended well" in said.stdout, said.stderr[-2000:]


def test_a_cluster_must_name_the_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stored.shared_dir(Session())
