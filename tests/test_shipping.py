import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from phrasewright.functions.text import nfc
print("GOT", spark.createDataFrame([("e\\u0301",)], "s string").select(nfc("s")).first()[0] == "\\u00e9")
"""


def test_workers_get_the_source_wherever_the_driver_runs(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT True" in done.stdout, done.stderr[-800:]
