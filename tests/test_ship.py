"""Queries with Python stages run from any folder, without PYTHONPATH."""

import os
import subprocess
import sys

from urnwise.cluster import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", len(e.queries()["hyp_p_values"](spark, {sf!r}).collect()))
"""


def test_from_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 288" in out.stdout, out.stderr[-1500:]
