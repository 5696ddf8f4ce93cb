"""Scratch tables and the folder they go to."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cadenza.llm import common
from cadenza.streaming import run


def test_purge_removes_what_was_made(spark):
    df = common.materialize(spark.range(5), "some")
    assert df.count() == 5 and df._scratch_path in common._MADE
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert store.exists(path)
    common.purge(spark)
    assert not store.exists(path) and common._MADE == []


@pytest.mark.parametrize("folder", [common.shared_dir, run.shared_folder])
def test_a_cluster_needs_a_shared_folder(folder):
    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(cluster)
    there = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs://x/y/"), sparkContext=None)
    assert folder(there) == "hdfs://x/y"


def test_a_written_table_leaves_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = held()
    out = common.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 7
