"""A packing worker's memory while it works and while it waits for later stages."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from skyframe.llm.packing import token_pieces
from skyframe.llm.queries import byte_bpe

WORKER = """
import random, re, sys, threading, time
import pyarrow as pa
from pyspark import cloudpickle

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

draw = random.Random(5)
words = ["".join(draw.choices("abcdefghij", k=7)) for _ in range(20_000)]
texts = pa.array([" ".join(draw.choices(words, k=480)) for _ in range(7_000)])
docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"])
run = cloudpickle.load(open(sys.argv[1], "rb"))
list(run([docs.slice(0, 10)]))
before, most = held(), [0]

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.02)

threading.Thread(target=watch, daemon=True).start()
rows = sum(b.num_rows for b in run([docs]))
print(rows, most[0] - before, held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_packing_worker_memory(spark, tmp_path, monkeypatch):
    found = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, *a, **b: found.append(run) or self)
    assert isinstance(token_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), byte_bpe()), DataFrame)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(found[0]))
    root = Path(__file__).parents[2]
    out = subprocess.run([sys.executable, "-c", WORKER, str(tmp_path / "run")], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    rows, working, waiting = int(out[0]), float(out[1]), float(out[2])
    assert rows > 7_000  # 27 MB of text, each of over 2048 ids
    assert working < 80  # MB
    assert waiting < 60
