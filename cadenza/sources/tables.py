"""Readers and writers of the measurement tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import schemas


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType, **options) -> DataFrame:
    """A table with the writer's header; columns are matched by name, extra ones
    ignored and missing ones null."""
    raw = spark.read.options(**(schemas.CSV_OPTIONS | options)).option("inferSchema", False).csv(path)
    nan = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}
    out = []
    for f in schema.fields:
        if f.name not in raw.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.nullif(F.trim(F.col(f.name)), F.lit(""))
        if f.dataType.typeName() == "double":
            for k, v in nan.items():
                c = F.when(F.lower(c) == k, v).otherwise(c)
        out.append(c.try_cast(f.dataType).alias(f.name))
    return raw.select(*out)


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of a file each, or of a line each: (video, width, height, frame, time_seconds, corners) a row; a document
    without frames, or a frame without exactly four corners, is an error."""
    docs = spark.read.schema(schemas.ANNOTATIONS).json(path, multiLine=not lines)
    empty = F.raise_error(F.lit("annotations without frames"))
    docs = docs.withColumn("frames", F.when(F.coalesce(F.size("frames"), F.lit(0)) > 0, F.col("frames")).otherwise(empty))
    rows = docs.select("video", "output_size.width", "output_size.height", F.explode("frames").alias("f"))
    four = (F.size("f.corners") == 4) & F.forall("f.corners", lambda c: F.size(c) == 2)
    corners = F.when(four, F.col("f.corners")).otherwise(F.raise_error(F.lit("a frame needs four corners")))
    return rows.select("video", "width", "height", "f.frame", "f.time_seconds", corners.alias("corners"))


def read_summary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Stability summary documents of a file each, or of a line each, a row per
    video."""
    docs = spark.read.schema(schemas.SUMMARY).json(path, multiLine=not lines)
    return docs.select("generated_at", F.explode("summary").alias("s")).select("generated_at", "s.video", "s.all", "s.last_seconds")


def video_metadata(videos: DataFrame, strict: bool = False, fallback_fps: float = 60.0) -> DataFrame:
    """videos with a usable fps and duration_seconds; strict raises on a video
    without fps or size."""
    good = (F.col("fps") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(fallback_fps))
    if strict:
        fps = F.when(good, F.col("fps")).otherwise(F.raise_error(F.concat(F.lit("no usable metadata: "), F.col("video"))).cast("double"))
    out = videos.withColumn("fps", fps)
    return out.withColumn("duration_seconds", F.when(F.coalesce("frame_count", F.lit(0)) > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def frames_at(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """Random access: the frames of keys(video, frame); a key beyond a video's
    frames is an error where it is read."""
    found = keys.join(frames, ["video", "frame"], "left")
    missing = F.raise_error(F.concat(F.lit("no frame "), F.col("frame").cast("string"), F.lit(" in "), F.col("video")))
    return found.withColumn("data", F.when(F.col("data").isNotNull(), F.col("data")).otherwise(missing.cast("binary")))


def write_csv(df: DataFrame, path: str, schema: StructType, mode: str = "errorifexists", even_empty: bool = True) -> bool:
    """The fixed header: other columns are left out, missing ones blank. Without
    even_empty nothing is written for a table of no rows; tells what was done."""
    if not even_empty and df.isEmpty():
        return False
    have = set(df.columns)
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    df.select(*out).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return True


def write_by_keys(df: DataFrame, path: str, fields: str, order: str, mode: str = "errorifexists") -> list[str] | None:
    """Rows of maps (text by name) as CSV whose header is the first row's keys in
    their order; other keys are left out, missing ones blank. Tells the header; a
    table of no rows isn't written (None)."""
    first = df.select(order, F.map_keys(fields).alias("keys")).agg(F.min_by("keys", order).alias("keys")).first()["keys"]
    if first is None:
        return None
    df.select(*[F.try_element_at(fields, F.lit(k)).alias(k) for k in first]).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return first


def run_names(df: DataFrame, key: list[str], name: str, order: str) -> DataFrame:
    """df with its `name` made unique within each key: the first by order keeps
    it, the others are name_01, name_02, ..."""
    k = F.row_number().over(Window.partitionBy(*key, name).orderBy(order)) - 1
    number = k.cast("string")
    shown = F.concat(F.lit("_"), F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")))
    return df.withColumn("name", F.concat(name, F.when(k == 0, "").otherwise(shown)))


def summary_documents(summaries: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """A document (json) for each row of summaries(video, all, last_seconds);
    videos are never gathered to one."""
    stamp = (generated_at or datetime.now()).replace(microsecond=0).isoformat()
    entry = F.array(F.struct("video", "all", "last_seconds"))
    return summaries.select(F.to_json(F.struct(F.lit(stamp).alias("generated_at"), entry.alias("summary"))).alias("json"))


def annotation_document(frames: DataFrame, generated_at: datetime | None = None) -> DataFrame:
    """(video, json) of frames(video, width, height, frame, time_seconds,
    corners)."""
    stamp = (generated_at or datetime.now()).replace(microsecond=0).isoformat()
    rows = F.array_sort(F.collect_list(F.struct("frame", "time_seconds", "corners")))
    grouped = frames.groupBy("video", "width", "height").agg(rows.alias("frames"))
    doc = F.struct(F.lit(stamp).alias("generated_at"), "video", F.struct("width", "height").alias("output_size"), "frames")
    return grouped.select("video", F.to_json(doc).alias("json"))


def output_name(output: Column, source: Column, folder: Column) -> Column:
    """Where a run's video goes: the asked name, else the source's stem with
    `_normalized`, always within the run's folder; .mp4 if it has no ending."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    stem = F.regexp_replace(last(source), r"(?<=.)\.[^.]*$", "")
    name = F.coalesce(last(F.nullif(output, F.lit(""))), F.concat(stem, F.lit("_normalized.mp4")))
    return F.concat(folder, F.lit("/"), F.when(name.rlike(r".\.[^.]+$"), name).otherwise(F.concat(name, F.lit(".mp4"))))


def run_directory(spark: SparkSession, root: str, name: str) -> str:
    """The first of name, name_01 ... name_999 that isn't there, created; on any
    file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(1000):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}" + (f"_{k:02d}" if k else ""))
        store = path.getFileSystem(conf)
        if not store.exists(path) and store.mkdirs(path):
            return path.toString()
    raise FileExistsError(f"{name} and its 999 successors exist under {root}")
