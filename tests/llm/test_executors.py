"""Operators on three executors, each with its own shuffle files, over tables dealt into many map partitions."""

import json
import os
import subprocess
import sys
from pathlib import Path

from tests.llm.test_suffix_dedup import brute

ROOT = str(Path(__file__).resolve().parent.parent.parent)
CODE = """
import json, sys
from pyspark.sql import SparkSession
from textloom.llm.simhash import near_copies, simhash_groups
from textloom.llm.suffix_dedup import suffix_dedup

spark = (SparkSession.builder.master("local-cluster[3,2,1408]").config("spark.executor.memory", "1408m").config("spark.sql.shuffle.partitions", "12").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.warehouse.dir", sys.argv[1] + "/w").getOrCreate())
docs = spark.read.parquet(sys.argv[2]).repartition(24)
out = {"runs": [[list(r) for r in suffix_dedup(docs).collect()] for _ in range(3)]}
out["groups"] = [list(r) for r in simhash_groups(docs).collect()]
out["kept"] = [r.doc_id for r in near_copies(docs).collect()]
print("RESULT " + json.dumps(out))
spark.stop()
"""


def test_results_on_three_executors(spark, sf_dir, tmp_path):
    from textloom.llm.simhash import near_copies, simhash_groups

    path = f"{sf_dir}/documents.parquet"
    env = os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path), path], env=env, capture_output=True, text=True, timeout=400)
    lines = [x for x in done.stdout.splitlines() if x.startswith("RESULT ")]
    assert lines, done.stderr[-2000:]
    out = json.loads(lines[0][7:])
    docs = spark.read.parquet(path)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    for run in out["runs"]:
        assert {r[0]: tuple(r[1:5]) for r in run} == want
    assert sorted(map(tuple, out["groups"])) == sorted(map(tuple, simhash_groups(docs).collect()))
    assert sorted(out["kept"]) == sorted(r.doc_id for r in near_copies(docs).collect())
