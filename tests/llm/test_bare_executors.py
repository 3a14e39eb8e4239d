"""Every opN_ query and the pipeline where the workers cannot import this package."""

import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def absent(batches):
    for b in batches:
        try:
            import quarry
        except ModuleNotFoundError:
            yield b

assert spark.range(1).mapInArrow(absent, "id long").count() == 1
import __spark_entry__
names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2:].split("_")[0].isdigit()]
for n in names:
    print("ROWS", n, __spark_entry__.queries()[n](spark, {data!r}).count(), flush=True)
"""


def tables(path):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = [" ".join(r.choices(words, k=40)) for _ in range(60)]
    text += [text[0], None, "", " ".join(text[1].split()[:39])]
    n = len(text)
    put = lambda name, **c: pq.write_table(pa.table(c), f"{path}/{name}.parquet")
    put("documents", doc_id=list(range(n)), text=text, lang=["en"] * n, source=[f"s{i % 3}" for i in range(n)], n_chars=[len(t or "") for t in text])
    put("labels", doc_id=list(range(n)), quality=[1] * n, toxic=[i % 2 for i in range(n)])
    put("benchmark", item_id=[1, 2], text=[" ".join(text[3].split()[5:20]), "w1 w2"])
    put("embeddings", vec_id=list(range(60)), embedding=[[float(x) for x in np.random.default_rng(i).normal(0, 1, 64)] for i in range(60)], label=[0] * 60)
    put("conversations", conv_id=[1, 1, 2], turn=[0, 1, 0], role=["user", "assistant", "user"], text=["hi", "ho", None])


def test_workers_need_no_package(tmp_path):
    tables(tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO, data=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROWS"))
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(rows) == 14 and rows["op4_toxicity"] == "64" and rows["op3_benchmark_decontamination"] == "64"
