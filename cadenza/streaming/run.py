"""Run a stream over what is there now and read its result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this process wrote to the shared folder; sources.scratch.purge() removes it.
MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a
    local master without it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="cadenza-stream-")).rstrip("/")


def drain(out: DataFrame, mode: str = "append") -> DataFrame:
    """Every batch is written as Parquet: appended, or in complete mode in place
    of the one before. Nothing is gathered on the driver."""
    spark = out.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    MADE.append(root)

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{root}/rows/batch={number}" if mode == "append" else f"{root}/rows"
        batch.write.mode("overwrite").parquet(path)

    run = out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{root}/rows")
    return rows.select(*out.columns)
