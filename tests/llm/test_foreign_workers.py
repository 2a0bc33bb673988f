"""Executors have no copy of the repository: the queries run with workers that are started elsewhere and can't import it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's own path; workers don't get it
import __spark_entry__ as entry
from pyspark.sql import SparkSession, functions as F

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def importable(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(id=[int(importlib.util.find_spec("adjudica") is not None)] * len(batch))

assert spark.range(8).mapInPandas(importable, "id long").agg(F.max("id")).first()[0] == 0
for name, run in entry.queries().items():
    if name == "pipeline" or name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10", "op12", "op13"):
        print(name, run(spark, {small!r}).count(), flush=True)
for name in ("ab_predictions", "repair_advice", "cdc_feed"):
    print(name, entry.queries()[name](spark, {small!r}).count(), flush=True)
"""


def test_queries_run_on_workers_without_the_repository(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT.format(root=root, small="/root/testdata/sf0.001"))
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    names = [line.split()[0] for line in done.stdout.splitlines() if line.startswith(("op", "pipeline", "ab_", "repair_", "cdc_"))]
    assert done.returncode == 0 and len(names) == 14, done.stdout[-500:] + done.stderr[-3000:]
