import time
from pathlib import Path

from pyspark.sql import functions as F

from docloom import scratch as module
from docloom.scratch import Scratch


def test_shuffle_files_of_a_written_table_go_when_freed(spark, monkeypatch):
    monkeypatch.setattr(module, "SLOW_S", 0, raising=False)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    scratch, before = Scratch(spark, "freed"), files()
    kept = scratch.keep(spark.range(200_000).groupBy(F.col("id") % 50_000).count(), "counts")
    assert files() - before
    scratch.free()
    end = time.time() + 2
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before and kept.count() == 50_000
