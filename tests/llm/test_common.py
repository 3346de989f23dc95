"""Tables that operators write go when the driver ends, also after its session was stopped."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession
from weftline.llm import common, queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
common.materialise(spark.range(9).toDF("x"), "a")
b = common.materialise(spark.range(9).toDF("x"), "b")
common.discard(b)
d = sys.argv[2]
spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").write.parquet(d + "/documents.parquet")
assert queries.QUERIES["op2_rans"](spark, d).count() == 2
spark.stop()
"""


def test_nothing_stays_after_a_stopped_session(tmp_path):
    shared, data = tmp_path / "shared", tmp_path / "data"
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(shared), str(data)], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [p for p in shared.rglob("*") if p.is_file()] == []
