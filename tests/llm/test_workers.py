import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from plansmith.llm import registry
for name in ("op1_toxicity", "op2_chat", "op3_language", "op5_neighbours", "op6_decontamination", "op9_secrets"):
    assert registry.queries()[name](spark, {data!r}).count() > 0, name
print("done")
"""


def test_workers_need_no_copy_of_the_package(data, tmp_path):
    """Only the driver can import the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.endswith("done\n"), out.stderr[-3000:]
