"""The entry points with and without the part for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
#: Lists the queries, and runs one where Spark sees the copied tree alone.
SCRIPT = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names, sql = set(e.queries()), set(e.oracle_sql())
assert sql <= names and "m6_return_periods" in names and not [n for n in names if n.startswith("op") or n == "pipeline"], names
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["a2_storm_centers"](spark, e.SMOKE).count() > 0
"""


def test_queries_without_the_training_data_operators(tmp_path):
    """Both with the pipeline's file left at the top and without it."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "stormshift", tmp_path / "stormshift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    environment = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    for _ in range(2):
        found = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300, check=False)
        assert found.returncode == 0, found.stderr[-2000:]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
