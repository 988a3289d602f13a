"""Executors that do not find the package get it."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from airrline.llm import secrets
rows = spark.createDataFrame([(1, "token = abcdefghijklmnop")], "doc_id long, text string")
print("SPANS", len(secrets.find_secrets(rows).first()["spans"]))
"""


def test_package_travels(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(home=str(Path(__file__).resolve().parents[2]))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "SPANS 1" in done.stdout, done.stderr[-2000:]
