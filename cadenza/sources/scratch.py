"""Tables written aside in the shared folder: lineage ends there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.run import MADE, shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which purge() removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that is read back; drop() removes it. Its joins are
    merges: Spark knows a file's compressed size, which says little of its rows or
    of what they are exploded to, and would send them all through the driver."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    out._written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Remove what written() made, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path in MADE:
            remove(df.sparkSession, path)
            MADE.remove(path)


def purge(spark: SparkSession) -> None:
    """Remove all that this process wrote aside, drained streams included: once no
    lazy result reads it."""
    while MADE:
        remove(spark, MADE.pop())
