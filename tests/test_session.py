import os
import subprocess
import sys

import pytest

from fleetloom import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from fleetloom.operators.alarms import converge_exact
df = spark.createDataFrame([("a", i * 100) for i in range(7)], "k string, s long").selectExpr("k", "timestamp_seconds(s) as ts")
print("SENT", converge_exact(df, ["k"], "ts", 300).count())
"""


def test_python_functions_run_where_the_package_is_not_on_the_path(tmp_path):
    out = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=REPO)], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "SENT 3" in out.stdout, out.stderr[-2000:]


def test_shared_root_is_the_named_folder(spark):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.work_folder(spark, "x") != session.work_folder(spark, "x")


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Cluster())


def test_pin_survives_and_keeps_rows(spark):
    df = spark.range(100).repartition(7)
    assert session.pin(df).count() == 100
    assert spark.sparkContext.getCheckpointDir().startswith(("file:" + spark.conf.get("spark.checkpoint.dir"), spark.conf.get("spark.checkpoint.dir")))
