"""A token store worker's memory while it works and while it waits for later stages."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from skyframe.llm import token_store
from skyframe.llm.queries import byte_bpe
from test_memory import WORKER


class Caught(Exception):
    pass


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_token_store_worker_memory(spark, tmp_path, monkeypatch):
    found = []

    def caught(self, run, *a, **b):
        found.append(run)
        raise Caught

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", caught)
    with pytest.raises(Caught):
        token_store.write_token_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(tmp_path / "t"), byte_bpe(), 2)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(found[0]))
    keys = 'pa.array(range(len(texts)), pa.int64()), texts], names=["doc_id", "text"]'
    assert keys in WORKER
    worker = WORKER.replace(keys, '*4 * [pa.array(range(len(texts)), pa.int64())], texts], names=["_range", "_set", "_id", "_mix", "text"]')
    out = subprocess.run([sys.executable, "-c", worker, str(tmp_path / "run")], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    rows, working, waiting = int(out[0]), float(out[1]), float(out[2])
    assert rows == 7_000
    assert working < 90  # MB
    assert waiting < 60
