"""Frame samples."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def even_frames(videos: DataFrame, k: int, key: str = "video", count: str = "frame_count") -> DataFrame:
    """k evenly spaced frames of each video, half to even; one is frame 0."""
    out = videos.filter(F.col(count) > 0).select(key, count, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample"))
    at = F.lit(0).cast("double") if k == 1 else F.bround(F.col("sample") * (F.col(count) - 1) / F.lit(float(k - 1)))
    return out.select(key, "sample", at.cast("long").alias("frame"))


def stride(rows: DataFrame, every: int, most: int | None = None, key: str = "video", frame: str = "frame") -> DataFrame:
    """Every n-th frame, the first `most` of them in each video."""
    out = rows.filter(F.col(frame) % every == 0)
    if most is None:
        return out
    w = Window.partitionBy(key).orderBy(frame)
    return out.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__rank")


def first_frames(rows: DataFrame, most: int, frame: str = "frame") -> DataFrame:
    return rows.filter(F.col(frame) < most)
