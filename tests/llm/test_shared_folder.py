import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent.parent
CODE = """
from pyspark.sql import SparkSession
from gridpoint.llm.common import shared_folder, written
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert written(spark.range(5), "five").count() == 5
print("FOLDER", shared_folder(spark))
spark.stop()
"""


def test_a_session_without_a_checkpoint_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    folder = next(x.split()[-1] for x in done.stdout.splitlines() if "FOLDER" in x)
    assert not Path(folder.removeprefix("file:")).exists()  # removed at the application's end


def test_a_cluster_has_to_name_one(monkeypatch):
    from types import SimpleNamespace as N

    from gridpoint.llm.common import shared_folder

    spark = N(sparkContext=N(applicationId="app-of-a-cluster", master="spark://host:7077"), conf=N(get=lambda *_: None))
    try:
        shared_folder(spark)
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError
