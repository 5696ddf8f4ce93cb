"""Join shapes: spine, ragged series, nearest time, as-of, near-duplicates,
mutual nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import nearest_frame


def reliability_spine(videos: DataFrame, tracker: DataFrame, video: str = "video", frame: str = "frame", seq: str = "seq") -> DataFrame:
    """Every frame of videos(video, frame_count) with its reliability: the last
    tracker row by seq, true if there is none; frame 0 is always true. Rows out
    of range or without a frame number fall away."""
    spine = videos.filter("frame_count > 0").select(F.col(video), F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count").cast("long") - 1)).alias(frame))
    told = tracker.filter(F.col(frame).isNotNull()).groupBy(video, frame).agg(F.max_by("accepted", seq).alias("accepted"))
    joined = spine.join(told, [video, frame], "left")
    return joined.select(video, frame, (F.coalesce("accepted", F.lit(True)) | (F.col(frame) == 0)).alias("reliable"))


def ragged(series: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of series of unlike length, their columns prefixed."""
    out = None
    for name, df in series.items():
        named = df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])
        out = named if out is None else out.join(named, keys, "full_outer")
    return out


def strict_zip(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join: a key without a partner is an error where it is read."""
    l, r = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    both = l.join(r, keys, "full_outer")
    ok = F.when(F.col("__l") & F.col("__r"), True).otherwise(F.raise_error(F.lit("series of unlike length")).cast("boolean"))
    return both.withColumn("__ok", ok).filter("__ok").drop("__ok", "__l", "__r")


def clamped_lookup(rows: DataFrame, trajectory: DataFrame, key: str, frame: str) -> DataFrame:
    """The trajectory row of min(frame, last frame)."""
    last = trajectory.groupBy(key).agg(F.max(frame).alias("__last"))
    at = rows.join(last, key).withColumn("__at", F.least(F.col(frame), F.col("__last"))).drop("__last")
    right = trajectory.withColumnRenamed(frame, "__at")
    return at.join(right, [key, "__at"]).drop("__at")


def nearest_frames(times: DataFrame, videos: DataFrame, key: str, seconds: str) -> DataFrame:
    """times with the nearest frame of its video, a computed-key equi-join."""
    return times.join(videos.select(key, "fps", "frame_count"), key).withColumn("nearest", nearest_frame(F.col(seconds), F.col("fps"), F.col("frame_count")))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """left with the latest right values at or before its time: one union and
    one window in place of a range join. Rows of `right` at the same time come
    first; of equals the greatest `tie` counts."""
    l = left.withColumn("__side", F.lit(1))
    cols = [F.col(key), F.col(time), F.lit(0).alias("__side"), F.struct(*values).alias("__v")]
    r = right.select(*cols, *([F.col(tie).alias("__tie")] if tie else []))
    both = l.unionByName(r, allowMissingColumns=True)
    order = [time, "__side"] + ([F.col("__tie").asc_nulls_last()] if tie else [])
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*left.columns, *[F.col("__last")[v].alias(f"as_of_{v}") for v in values])


def without_near(new: DataFrame, known: DataFrame, key: list[str], distance: float, x: str = "x", y: str = "y") -> DataFrame:
    """New points with no known point nearer than `distance`: the known ones go
    to their own and the eight cells around, so the anti-join is an equi-join on
    cells with the exact test within."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    known = known.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col(x).alias("__x"), F.col(y).alias("__y"), cell(x).alias("__cx"), cell(y).alias("__cy"))
    spread = known.withColumn("__n", F.explode(near)).withColumns({"__cx": F.col("__cx") + F.col("__n.i"), "__cy": F.col("__cy") + F.col("__n.j")}).drop("__n")
    left = new.withColumns({"__gx": cell(x), "__gy": cell(y)})
    same = (left["__gx"] == spread["__cx"]) & (left["__gy"] == spread["__cy"])
    for k in key:
        same = same & (left[k] == spread[f"__k_{k}"])
    close = (left[x] - spread["__x"]) ** 2 + (left[y] - spread["__y"]) ** 2 < distance * distance
    return left.join(spread, same & close, "left_anti").drop("__gx", "__gy")


def matched_points(matches: DataFrame, reference: DataFrame, frame: DataFrame, key: list[str]) -> DataFrame:
    """matches(ref_index, frame_index) gathered from both point tables."""
    left = reference.withColumnRenamed("index", "ref_index").withColumnRenamed("x", "ref_x").withColumnRenamed("y", "ref_y")
    right = frame.withColumnRenamed("index", "frame_index").withColumnRenamed("x", "frame_x").withColumnRenamed("y", "frame_y")
    return matches.join(left, [*key, "ref_index"]).join(right, [*key, "frame_index"])


def mutual_nearest(scores: DataFrame, key: list[str], left: str, right: str, score: str) -> DataFrame:
    """Rows of scored pairs that are best for both ends; ties to the lesser
    partner."""
    best_l = scores.groupBy(*key, left).agg(F.min_by(right, F.struct(-F.col(score), F.col(right))).alias("__r"))
    best_r = scores.groupBy(*key, right).agg(F.min_by(left, F.struct(-F.col(score), F.col(left))).alias("__l"))
    return scores.join(best_l, [*key, left]).join(best_r, [*key, right]).filter((F.col("__r") == F.col(right)) & (F.col("__l") == F.col(left))).drop("__r", "__l")


def flag_members(rows: DataFrame, members: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return rows.join(members.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def concat_videos(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_points(points: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """The first k points of each group in their detector's order."""
    w = Window.partitionBy(*key).orderBy(order)
    return points.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def hit(points: DataFrame, key: list[str], x: float, y: float, radius: float, index: str = "i") -> DataFrame:
    """The point of each group that is nearest to a place, of equals the first;
    none beyond the radius."""
    far = F.hypot(F.col("x") - x, F.col("y") - y)
    near = points.withColumn("__d", far).filter(F.col("__d") <= radius)
    return near.groupBy(*key).agg(F.min_by(index, F.struct("__d", index)).alias(index))


def top_points(points: DataFrame, key: list[str], quality: str, k: int, tie: Column | str = "point_id") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(quality), tie)
    return points.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
