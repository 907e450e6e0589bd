"""Workers that can't import the package: every operator's functions and broadcasts carry what they need."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import corpus_pipeline
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
for key, query in corpus_pipeline.QUERIES.items():
    try:
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    except Exception as error:
        print("FAILED", key, str(error)[-400:])
    else:
        print("DONE", key)
"""


def test_every_query_runs_without_the_package_on_workers(tmp_path):
    import corpus_pipeline

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    lines = done.stdout.splitlines()
    assert [x for x in lines if x.startswith("FAILED")] == [], done.stdout
    assert sorted(x.split()[1] for x in lines if x.startswith("DONE")) == sorted(corpus_pipeline.QUERIES)
