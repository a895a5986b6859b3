"""The flagship in a small heap: its plan must stay small whatever the score's parts are."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import json, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
out = {{"entry": entry.entry(spark).count()}}
for name in ("stored_search", "o2_stream_search"):
    began = time.time()
    df = entry.queries()[name](spark, "/root/testdata/sf0.01")
    out[name] = [df.count(), time.time() - began, len(df._jdf.queryExecution().optimizedPlan().toString())]
print("RESULT", json.dumps(out))
"""


def test_searches_plan_and_run_in_a_small_heap():
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT)], capture_output=True, text=True, timeout=300)
    line = next((x for x in done.stdout.splitlines() if x.startswith("RESULT ")), None)
    assert line, done.stderr[-2000:]
    out = json.loads(line.removeprefix("RESULT "))
    for name in ("stored_search", "o2_stream_search"):
        rows, seconds, plan = out[name]
        assert rows > 0
        assert seconds < 30  # ten at most on an idle machine
        assert plan < 400_000
