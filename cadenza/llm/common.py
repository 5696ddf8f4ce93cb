"""Shared plumbing: inputs, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes that a Python worker is handed at a time; Spark's own default is 64 MB.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Whether a query's shuffle files go when it ends; by default they stay until the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers started from now on import this package, and bound
    what they are handed at a time unless the session says otherwise."""
    if spark.conf.get(_BATCH, None) == f"{64 << 20}b":
        spark.conf.set(_BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a
    local master without it (tests) a temporary one that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def purge(spark: SparkSession) -> None:
    """Remove every scratch table and archive of this process: once no lazy
    result reads them any more."""
    while _MADE:
        remove(spark, _MADE.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage
    ends there, a lost executor costs no recomputation, and the shuffle files that
    led there go at once."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new query, which heeds the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame | None) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)


def id_text(id_col: str) -> Column:
    """An id on its way through pandas, which holds a column of whole numbers
    with nulls as doubles and loses digits; with_id() takes it back."""
    return F.col(f"`{id_col}`").cast("long").cast("string")


def with_id(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
