"""Results stay the same when tasks die and run again: in a session of its own, which retries them."""

import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from rasterloom.llm import decontaminate, html, jaccard, linededup, packing, rules, simhash, suffixdedup

spark = SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
docs = spark.read.parquet({data!r} + "/documents.parquet").select("doc_id", "text").repartition(4, "doc_id")
pages = spark.read.parquet({data!r} + "/pages.parquet").repartition(4, "page_id")
bench = spark.read.parquet({data!r} + "/benchmark.parquet")


def dying(batches):
    from pyspark import TaskContext

    task, seen = TaskContext.get(), False
    for b in batches:
        yield b
        seen = True
    if seen and task.attemptNumber() == 0 and task.partitionId() % 2:
        raise RuntimeError("this task is lost")


def flaky(df):
    return df.mapInArrow(dying, df.schema)


cases = {{
    "contamination": (docs, lambda d: decontaminate.contamination(d, bench).select("doc_id", "n_hit", F.array_join("item_ids", ",").alias("i"))),
    "near": (docs, simhash.near_duplicates), "dedup": (docs, lambda d: jaccard.near_dedup(d).select("doc_id")), "lines": (docs, lambda d: linededup.line_dedup(d).select("doc_id", "n_dropped", F.md5("text"))),
    "suffix": (docs, lambda d: suffixdedup.suffix_dedup(d).select("doc_id", "n_removed", F.md5("kept"))), "rules": (docs, lambda d: rules.quality_report(d).select("doc_id", "kept", F.round("p_good", 6))),
    "html": (pages, lambda d: html.extract(d).select("page_id", F.md5("text"))),
}}
for name, (frame, f) in cases.items():
    a, b = (sorted(map(str, f(x).collect())) for x in (frame, flaky(frame)))
    assert a == b and a, name
print("same")
"""


def test_results_survive_lost_tasks(data):
    import rasterloom

    root = rasterloom.__path__[0].rsplit("/", 1)[0]
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, data=data)], capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().endswith("same"), done.stderr[-3000:]
