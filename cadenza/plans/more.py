"""The catalogue's second half: tables in and out, gates, folds of whole corner
trajectories, table functions. See catalogue.py for the stand-in tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import folds as D
from ..operators import gates as Q
from ..operators import joins as J
from ..operators import point_ages as P
from ..operators import sampling as S
from ..operators.timeseries import Series, smooth_corners, smooth_residual
from ..sources import schemas, scratch
from ..sources import tables as IO
from .catalogue import (
    _AFFINE, _CORNERS, _EDGES, _OBS, _ORDERED, _PICK, _POINTS, _QUADS, _ROW, SERIES, _affines, _corner_columns, _near, _points, _quads, _r, _recursive, _stream, observations, query, read, rounded,
)
from .config import Config, with_profiles


def _folder(spark) -> str:
    return scratch.folder(spark, "tables")


# ---- sources

_VIDEOS = "videos AS (SELECT CAST(p_partkey AS VARCHAR) AS video, p_size * 10 AS width, p_size * 5 AS height, CAST(CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size + 0.5 END AS DOUBLE) AS fps, p_partkey % 300 AS frame_count FROM part)"


def _videos(spark, d):
    size = F.col("p_size")
    return read(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("video"), (size * 10).alias("width"), (size * 5).alias("height"),
        F.when(size % 5 == 0, 0.0).otherwise(size + 0.5).alias("fps"), (F.col("p_partkey") % 300).cast("int").alias("frame_count"),
    )


@query(f"WITH {_VIDEOS}, f AS (SELECT video, CASE WHEN fps > 0 THEN fps ELSE CAST(60 AS DOUBLE) END AS fps, frame_count FROM videos) SELECT video, {_r('fps')} AS fps, {_r('frame_count / fps')} AS duration_seconds FROM f")
def metadata_probe(spark, d):
    """Frames per second, 60 where unknown, and durations."""
    return rounded(IO.video_metadata(_videos(spark, d)).select("video", "fps", "duration_seconds"))


@query(f"WITH {_VIDEOS} SELECT video, {_r('fps')} AS fps, {_r('frame_count / fps')} AS duration_seconds FROM videos WHERE fps > 0")
def metadata_strict(spark, d):
    """The same where a video without fps is an error: probed first, so that the
    strict reading gets none and would end at one."""
    known = IO.video_metadata(_videos(spark, d)).join(_videos(spark, d).filter("fps > 0").select("video"), "video", "left_semi")
    return rounded(IO.video_metadata(known.drop("duration_seconds"), strict=True).select("video", "fps", "duration_seconds"))


@query("WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame FROM orders) SELECT CAST(o_custkey AS VARCHAR) AS video, frame, CAST(o_orderkey AS VARCHAR) AS data FROM f WHERE frame <= 1")
def random_access(spark, d):
    """The first frames of each video by key."""
    s = Series("o_custkey", "o_orderkey")
    frames = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("video"), s.index().cast("int").alias("frame"), F.col("o_orderkey").cast("string").cast("binary").alias("data"))
    keys = frames.filter("frame <= 1").select("video", "frame")
    return IO.frames_at(frames, keys).select("video", F.col("frame").cast("long").alias("frame"), F.col("data").cast("string").alias("data"))


_FRAME_SQL = "SELECT CAST(label AS VARCHAR) AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, 8 AS height, md5(unhex(array_to_string(list_transform(embedding, lambda v: lpad(hex(CAST(floor(CAST(v AS DOUBLE) * 100) AS BIGINT) + 128), 2, '0')), ''))) AS pixels FROM embeddings"


def _frames(spark, d):
    """An embedding as a frame of 8 by 8 bytes, its label as the video."""
    e = read(spark, d, "embeddings")
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.floor(v.cast("double") * 100) + 128), 2, "0")), ""))
    frame = Series("label", "vec_id").index().cast("int")
    return e.select(F.col("label").cast("string").alias("video"), frame.alias("frame"), *[F.lit(v).alias(n) for n, v in (("height", 8), ("width", 8), ("channels", 1))], data.alias("data"))


def _landed(spark, frames):
    from ..sources import landed

    landed.register(spark)
    path = scratch.folder(spark, "frames")
    frames.sortWithinPartitions("video", "frame").write.format("landedframes").mode("append").save(path)
    return path


def _shown(frames):
    return rounded(frames.select("video", "frame", "height", F.md5("data").alias("pixels")))


@query(_FRAME_SQL)
def raw_video_scan(spark, d):
    """Frames landed by a sink and scanned in runs of seven."""
    path = _landed(spark, _frames(spark, d))
    return _shown(spark.read.format("landedframes").option("framesPerPartition", 7).load(path))


@query(_FRAME_SQL)
def streamed_frames(spark, d):
    """Frames landed in two goes and read as a stream."""
    from ..streaming.run import drain

    frames = _frames(spark, d)
    path = _landed(spark, frames.filter("frame % 3 = 0"))
    frames.filter("frame % 3 <> 0").write.format("landedframes").mode("append").save(path)
    return _shown(drain(spark.readStream.format("landedframes").load(path)))


# ---- tables written and read again


def _again(spark, df, schema, even_empty: bool = True):
    path = _folder(spark)
    IO.write_csv(df.withColumn("left_out", F.lit(1)), path, schema, even_empty=even_empty)
    return IO.read_csv(spark, path, schema)


_STABILITY = {"translation_px": "value", "scale": "1 + value / 1000", "inlier_ratio": "value / 200"}


@query(f"WITH {_OBS} SELECT CAST(user_id AS VARCHAR) AS video, i AS frame, {_r('t')} AS time_seconds, ok, event_type AS reason, {', '.join(f'CASE WHEN ok THEN {_r(v)} END AS {k}' for k, v in _STABILITY.items())}, CAST(NULL AS BIGINT) AS feature_count FROM obs")
def stability_csv(spark, d):
    """The stability table through CSV: fixed header, blanks are nulls."""
    e = observations(spark, d).withColumn("frame", SERIES.index())
    e = e.withColumns({"video": F.col("user_id").cast("string"), "time_seconds": F.col("t"), "reason": F.col("event_type"), **{k: F.when(F.col("ok"), F.expr(v)) for k, v in _STABILITY.items()}})
    out = _again(spark, e.select("video", "frame", "time_seconds", "ok", "reason", *_STABILITY), schemas.STABILITY)
    return rounded(out.select("video", "frame", "time_seconds", "ok", "reason", *_STABILITY, "feature_count"))


@query(f"WITH {_ORDERED}, {_EDGES} SELECT q AS frame, vec_id % 3 > 0 AS accepted, CAST(vec_id AS VARCHAR) AS reason, 1e308 * 10 > 1 AS is_infinite, {_r('area')} AS area, {', '.join(f'{_r(c)} AS {c}' for c in _CORNERS)} FROM edged")
def tracker_csv(spark, d):
    """Tracker rows through CSV, with infinite errors."""
    q = _quads(spark, d)
    rows = q.select(F.col("q").alias("frame"), (F.col("vec_id") % 3 > 0).alias("accepted"), F.col("vec_id").cast("string").alias("reason"), F.lit(float("inf")).alias("reprojection_error"), G.area(F.col("quad")).alias("area"), *_corner_columns(F.col("quad")))
    out = _again(spark, rows, schemas.TRACKER)
    return rounded(out.select("frame", "accepted", "reason", (F.col("reprojection_error") == float("inf")).alias("is_infinite"), "area", *_CORNERS))


@query(f"WITH {_ORDERED} SELECT vec_id * 8 + q AS frame, q % 2 = 0 AS reliable, {', '.join(f'{_r(c)} AS {k}_{c}' for k in ('raw', 'smoothed') for c in _CORNERS)}, CAST(NULL AS DOUBLE) AS interpolated_tl_x FROM ordered")
def trajectory_csv(spark, d):
    """A trajectory table through CSV; a missing part is null."""
    q = _quads(spark, d).select((F.col("vec_id") * 8 + F.col("q")).alias("frame"), (F.col("q") % 2 == 0).alias("reliable"), *_corner_columns(F.col("quad")))
    q = q.withColumns({f"{k}_{c}": F.col(c) for k in ("raw", "smoothed") for c in _CORNERS})
    out = _again(spark, q, schemas.TRAJECTORY)
    return rounded(out.select("frame", "reliable", *[f"{k}_{c}" for k in ("raw", "smoothed") for c in _CORNERS], "interpolated_tl_x"))


@query(f"WITH {_QUADS}, {_AFFINE} SELECT vec_id * 8 + q AS frame, (vec_id + q) % 4 = 0 AS missing, CASE WHEN (vec_id + q) % 4 <> 0 THEN {_r('tx')} END AS translation_x, CASE WHEN (vec_id + q) % 4 <> 0 THEN {_r('degrees(atan2(c, a))')} END AS rotation_deg FROM m")
def align_csv(spark, d):
    """Alignment rows through CSV: eight NaN where there is no transform."""
    h = _affines(spark, d).withColumn("h", F.when((F.col("vec_id") + F.col("q")) % 4 != 0, F.col("h")))
    rows = h.select((F.col("vec_id") * 8 + F.col("q")).alias("frame"), G.components(F.col("h")).alias("c")).select("frame", "c.*")
    out = _again(spark, rows, schemas.ALIGN)
    shown = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return rounded(out.select("frame", F.isnan("perspective_y").alias("missing"), shown("translation_x"), shown("rotation_deg")))


@query(f"WITH {_OBS} SELECT event_id AS sample, i AS frame, CASE WHEN ok THEN {_r('value')} END AS reprojection_error, event_type AS reason FROM obs")
def probe_csv(spark, d):
    """Probe rows through CSV, whose header are the first row's keys; a table of
    none isn't written."""
    e = observations(spark, d).withColumn("i", SERIES.index())
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("sample", F.col("event_id")), ("frame", F.col("i")), ("reprojection_error", F.col("value")), ("reason", F.col("event_type")))]
    fields = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.col("ok") | (p["k"] != "reprojection_error")))
    rows = e.select(F.struct((~F.col("ok")).alias("last"), "event_id").alias("at"), fields.alias("fields"))
    path = _folder(spark)
    none = IO.write_by_keys(rows.filter(F.lit(False)), path, "fields", "at")
    IO.write_by_keys(rows, path, "fields", "at")
    found = spark.read.option("header", True).csv(path).filter(F.lit(none is None))
    return rounded(found.select(F.col("sample").cast("long"), F.col("frame").cast("long"), F.col("reprojection_error").cast("double"), "reason"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE event_type <> 'error') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS rejected, CAST(count(DISTINCT user_id) AS BIGINT) AS series FROM events""")
def progress_counts(spark, d):
    """Counts of accepted and rejected rows that come with a written result."""
    from .progress import observed

    rows, counts = observed(observations(spark, d), "gate", F.col("ok"))
    done = scratch.written(rows.withColumn("smoothed", SERIES.running_count(~F.col("ok"))), "progress")
    told = counts.get
    series = done.agg(F.countDistinct("user_id").alias("series"))
    return series.select(*[F.lit(told[k]).cast("long").alias(k) for k in ("rows", "accepted", "rejected")], "series")


@query(f"WITH {_QUADS} SELECT CAST(vec_id AS VARCHAR) AS video, 640 AS width, q AS frame, {_r('q / 30.0')} AS time_seconds, {_r('x0')} AS x0, {_r('y3')} AS y3 FROM quads")
def annotations_round_trip(spark, d):
    """Annotation documents written, read and checked for four corners."""
    q = _quads(spark, d, ordered=False)
    corners = F.transform("quad", lambda p: F.array(p["x"], p["y"]))
    frames = q.select(F.col("vec_id").cast("string").alias("video"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("q").cast("int").alias("frame"), (F.col("q") / 30.0).alias("time_seconds"), corners.alias("corners"))
    path = _folder(spark)
    IO.annotation_document(frames, datetime(2026, 1, 1)).select("json").write.text(path)
    back = IO.read_annotations(spark, path, lines=True)
    return rounded(back.select("video", "width", "frame", "time_seconds", F.col("corners")[0][0].alias("x0"), F.col("corners")[3][1].alias("y3")))


@query("""WITH c AS (SELECT o_orderkey, coalesce(nullif(regexp_replace(regexp_replace('run ' || o_orderpriority, '[^\\pL\\pN_.-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'run') AS base, row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey) - 1 AS k, o_orderdate FROM orders)
SELECT o_orderkey, base || CASE WHEN k = 0 THEN '' ELSE '_' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(k AS VARCHAR))) AS INTEGER), '0') END AS name FROM c""")
def run_directories(spark, d):
    """The free names of a day's runs: the first as asked, the others numbered."""
    o = read(spark, d, "orders").withColumn("base", X.clean_path_part(F.concat(F.lit("run "), "o_orderpriority")))
    return IO.run_names(o, ["o_orderdate"], "base", "o_orderkey").select("o_orderkey", "name")


@query("SELECT p_partkey, '/runs/1/' || CASE p_size % 4 WHEN 0 THEN 'in.' || p_partkey || '_normalized.mp4' WHEN 1 THEN 'asked.mp4' WHEN 2 THEN 'asked.mkv' ELSE 'asked.' || p_partkey END AS path FROM part")
def output_resolution(spark, d):
    """Where a run's video goes."""
    p, k = read(spark, d, "part"), F.col("p_size") % 4
    asked = F.when(k == 1, "/else/asked").when(k == 2, "asked.mkv").when(k == 3, F.concat(F.lit("a/asked."), "p_partkey"))
    source = F.concat(F.lit("/videos/in."), "p_partkey", F.lit(".mov"))
    return p.select("p_partkey", IO.output_name(asked, source, F.lit("/runs/1")).alias("path"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 15 WHEN 1 THEN 1 ELSE p_size END AS point_age, CASE p_size % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 9 END AS median_window, CASE p_size % 3 WHEN 0 THEN 31 WHEN 1 THEN 1 ELSE 11 END AS mean_window FROM part""")
def profiles(spark, d):
    """What the presets leave of explicit settings, a row a run."""
    k = F.col("p_size") % 3
    asked = read(spark, d, "part").select("p_partkey", F.when(k == 0, "dynamic").when(k == 1, "low-latency").alias("profile"), F.col("p_size").alias("point_age"), F.lit(9).alias("median_window"), F.lit(11).alias("mean_window"))
    return rounded(with_profiles(asked).drop("profile"))


# ---- scalars and gates


@query(f"WITH {_OBS}, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM obs) SELECT event_id, {_r('pv + greatest(-5.0, least(5.0, value - pv))')} AS limited, {_r('i / 30.0')} AS seconds FROM p WHERE pv IS NOT NULL")
def step_limits_and_times(spark, d):
    """A step held to five either way, and a frame's time."""
    e = observations(spark, d).withColumns({"pv": SERIES.previous(F.col("value")), "i": SERIES.index()}).filter("pv is not null")
    return rounded(e.select("event_id", G.step_limited(F.col("pv"), F.col("value"), 5.0).alias("limited"), G.frame_time(F.col("i"), F.lit(30.0)).alias("seconds")))


_ANGLE = "90 - ((90 - {0}) - 180.0 * floor((90 - {0}) / 180.0))"


@query(f"WITH {_QUADS}, s AS (SELECT *, degrees(atan2(y1 - y0, x1 - x0)) AS a FROM quads) SELECT vec_id, q, {_r('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))')} AS length, {_r(_ANGLE.format('a'))} AS angle FROM s")
def segment_measures(spark, d):
    q = _quads(spark, d, ordered=False).withColumn("s", G.segment(F.col("quad")[0], F.col("quad")[1]))
    return rounded(q.select("vec_id", "q", "s.length", "s.angle"))


@query(f"WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_linenumber * 7.0 AS h, l_discount * 1000 - 90 AS angle FROM lineitem), t AS (SELECT *, CASE WHEN w < h THEN angle + 90 ELSE angle END AS turned FROM a) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_r('greatest(w, h)')} AS \"long\", {_r('least(w, h)')} AS short, {_r(_ANGLE.format('turned'))} AS angle FROM t")
def box_sides(spark, d):
    """A rotated box's sides and its long side's angle."""
    li = read(spark, d, "lineitem")
    s = G.box_sides(F.col("l_quantity"), F.col("l_linenumber") * 7.0, F.col("l_discount") * 1000 - 90)
    return rounded(li.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.*"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_quantity < 5 THEN 'not_enough_reference_points' WHEN l_returnflag = 'A' THEN 'flow_failed' WHEN l_linestatus = 'X' THEN 'backflow_failed'
  WHEN l_quantity < 20 THEN 'not_enough_valid_points' WHEN l_discount > 0.08 THEN 'affine_failed' WHEN l_tax * 1000 < 20 THEN 'too_few_inliers' END AS reason FROM lineitem""")
def alignment_pre_failures(spark, d):
    """What fails before there is a transform to judge."""
    c = F.col
    reason = Q.AlignGates.early_reason(c("l_quantity") * 4, c("l_returnflag") != "A", c("l_linestatus") != "X", c("l_quantity"), c("l_discount") <= 0.08, c("l_tax") * 1000, "affine")
    return rounded(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason")))


_BOX = "b AS (SELECT vec_id, q, CAST(abs(round(x0)) AS BIGINT) % 60 AS bx, CAST(abs(round(y0)) AS BIGINT) % 40 AS b_y, 1 + CAST(abs(round(x1)) AS BIGINT) % 100 AS bw, 1 + CAST(abs(round(y1)) AS BIGINT) % 60 AS bh FROM quads)"


@query(f"""WITH {_QUADS}, {_BOX} SELECT vec_id, q, bw * bh * 0.6 >= 0.002 * 100 * 60 AND greatest(bw, bh) >= 20 AND least(bw, bh) >= 3 AND bx < 80 AND bx + bw > 30 AND b_y < 30 AND b_y + bh > 10
  AND NOT ((bx <= 1 OR b_y <= 1 OR bx + bw >= 99 OR b_y + bh >= 59) AND (bw > 90 OR bh > 54)) AND greatest(bw, bh) * 1.0 / least(bw, bh) >= 1.2 AS ok FROM b""")
def component_filter(spark, d):
    """Which components can be a line: size, place, fill and form."""
    v = lambda i, a, n: F.abs(F.round(F.col("quad")[i][a])).cast("long") % n
    q = _quads(spark, d, ordered=False).select("vec_id", "q", v(0, "x", 60).alias("x0"), v(0, "y", 40).alias("y0"), (1 + v(1, "x", 100)).alias("w"), (1 + v(1, "y", 60)).alias("h"))
    w, h = F.col("w"), F.col("h")
    box = F.struct("x0", "y0", (F.col("x0") + w).alias("x1"), (F.col("y0") + h).alias("y1"))
    band = F.struct(F.lit(30).alias("x0"), F.lit(10).alias("y0"), F.lit(80).alias("x1"), F.lit(30).alias("y1"))
    fa = G.fill_and_aspect(w * h * 0.6, w, h)
    ok = Q.component_ok(w * h * 0.6, box, F.lit(100), F.lit(60), Q.boxes_intersect(box, band), F.greatest(w, h), F.least(w, h), fa["fill"], fa["aspect"], F.lit(0.0), 20, 3, 3.0)
    return q.select("vec_id", "q", ok.alias("ok"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag = 'N' AND l_quantity >= 15 AS mature FROM lineitem")
def maturity_filter(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", Q.mature(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("mature")))


@query(f"WITH {_POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((x - 10.0) * (x - 10.0) + (y + 20.0) * (y + 20.0)), i) AS k FROM pts WHERE sqrt((x - 10.0) * (x - 10.0) + (y + 20.0) * (y + 20.0)) <= 60) SELECT vec_id, i FROM n WHERE k = 1")
def hit_test(spark, d):
    """The nearest point to a place, within a radius."""
    return rounded(J.hit(_points(spark, d), ["vec_id"], 10.0, -20.0, 60.0))


# ---- joins, aggregates, limits


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def strict_zip(spark, d):
    """Two series of one length, side by side."""
    o = read(spark, d, "orders")
    return J.strict_zip(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_orderdate"), ["o_orderkey"])


@query(f"WITH {_POINTS} SELECT a.vec_id, a.i AS ref_index, b.i AS frame_index, {_r('a.x')} AS ref_x, {_r('b.y')} AS frame_y FROM pts a JOIN pts b ON b.vec_id = a.vec_id AND b.i = 31 - a.i")
def index_gather(spark, d):
    """Matches by index, gathered from both point tables."""
    p = _points(spark, d).select("vec_id", F.col("i").cast("long").alias("index"), "x", "y")
    matches = p.select("vec_id", F.col("index").alias("ref_index"), (31 - F.col("index")).alias("frame_index"))
    return rounded(J.matched_points(matches, p, p, ["vec_id"]).select("vec_id", "ref_index", "frame_index", "ref_x", "frame_y"))


@query(f"WITH {_OBS} SELECT user_id, event_id, i FROM obs WHERE i < 5")
def first_frames(spark, d):
    """Rows of the first frames only."""
    e = observations(spark, d).withColumn("i", SERIES.index().cast("long"))
    return S.first_frames(e, 5, "i").select("user_id", "event_id", "i")


@query(f"WITH {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM pts WHERE x > 0) SELECT vec_id, i FROM k WHERE k <= 6")
def first_inliers(spark, d):
    """The first points of each frame that pass, in the detector's order."""
    return rounded(J.first_points(_points(spark, d).filter("x > 0"), ["vec_id"], "i", 6).select("vec_id", "i"))


@query(f"WITH {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (abs(y) < 50)::INTEGER DESC, abs(x) DESC, i DESC) AS k FROM pts) SELECT vec_id, i AS edge FROM k WHERE k = 1")
def longest_inside(spark, d):
    """The edge that lies inside and is longest."""
    p = _points(spark, d).withColumns({"inside": F.abs("y") < 50, "length": F.abs("x")})
    return rounded(p.groupBy("vec_id").agg(A.best_by("i", "inside", "length", "i").alias("edge")))


@query(f"WITH {_ORDERED}, {_EDGES}, k AS (SELECT vec_id, q, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, q DESC) AS k FROM edged) SELECT vec_id, q AS contour FROM k WHERE k = 1")
def largest_contour(spark, d):
    q = _quads(spark, d).withColumn("area", G.area(F.col("quad")))
    return rounded(q.groupBy("vec_id").agg(A.best_by("q", "area", "q").alias("contour")))


@query("SELECT user_id, least(120.0, coalesce(quantile_cont(value, 0.3) FILTER (WHERE event_type <> 'view'), 120.0)) AS background FROM events GROUP BY user_id".replace("least(120.0, ", "round(least(120.0, ").replace("120.0)) AS", "120.0)), 6) + 0.0 AS"))
def background_level(spark, d):
    """The white threshold or a low percentile of the masked pixels."""
    e = read(spark, d, "events")
    return rounded(e.groupBy("user_id").agg(A.background_level(F.col("value"), F.col("event_type") != "view", 120.0, 0.3).alias("background")))


_UNIT = [0.9, 0.1, 30.0, -0.05, 1.1, 20.0, 0.0001, 0.0002, 2.0]


@query(f"WITH {_POINTS}, u AS (SELECT vec_id, (0.9 * x + 0.1 * y + 30.0) / (0.0001 * x + 0.0002 * y + 2.0) AS u, (-0.05 * x + 1.1 * y + 20.0) / (0.0001 * x + 0.0002 * y + 2.0) AS v FROM pts) SELECT vec_id, {_r('greatest(0.0, quantile_cont(u, 0.95) - quantile_cont(u, 0.05))')} AS coverage_x, {_r('greatest(0.0, quantile_cont(v, 0.95) - quantile_cont(v, 0.05))')} AS coverage_y FROM u GROUP BY vec_id")
def unit_coverage(spark, d):
    """Coverage of points seen through a transform."""
    p = _points(spark, d).groupBy("vec_id").agg(F.collect_list(G.point(F.col("x"), F.col("y"))).alias("p"))
    x, y = A.unit_coverage(F.col("p"), F.array(*map(F.lit, _UNIT)))
    return rounded(p.select("vec_id", x.alias("coverage_x"), y.alias("coverage_y")))


@query("SELECT user_id, event_type AS reason, count(*) AS n FROM events GROUP BY ALL")
def reasons_by_series(spark, d):
    """Each series' reasons and their counts, by way of a map."""
    told = A.reason_map(read(spark, d, "events"), "user_id", "event_type")
    return told.select("user_id", F.explode("reasons").alias("reason", "n"))


@query(f"WITH {_OBS} SELECT user_id, event_id, CAST(sum(CASE WHEN event_type IN ('error', 'view') AND value >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rejected_updates FROM obs")
def rejected_updates(spark, d):
    """Running count of rejections; failures before a transform (here values
    under 20) don't count."""
    e = observations(spark, d)
    rejected = F.col("event_type").isin("error", "view") & (F.col("value") >= 20)
    return e.select("user_id", "event_id", SERIES.running_count(rejected).alias("rejected_updates"))


@query(f"WITH {_POINTS} SELECT vec_id, i, {_r('x')} AS x, {_r('y')} AS y FROM pts")
def frame_points(spark, d):
    """Frames to points by a table function."""
    from ..operators.points import FramePoints

    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 1000).alias("xy"))
    return rounded(e.lateralJoin(FramePoints(F.col("xy").outer())).select("vec_id", "i", "x", "y"))


_AGES = f"""WITH {_OBS}, e AS (SELECT user_id, event_id, i, CAST(floor(value) AS BIGINT) % 6 AS p, event_type <> 'view' AS kept FROM obs),
d AS (SELECT a.event_id, f.p, f.p = a.p AS own, max(CASE WHEN NOT f.kept THEN f.i ELSE -1 END) AS dropped, arg_max(f.kept, f.i) AS alive FROM e a JOIN e f ON f.user_id = a.user_id AND f.i <= a.i GROUP BY 1, 2, 3),
n AS (SELECT event_id, count(*) FILTER (WHERE alive) AS points, max(CASE WHEN own THEN dropped END) AS since FROM d GROUP BY 1)
SELECT a.user_id, a.event_id, count(f.event_id) AS age, any_value(n.points) AS points FROM e a JOIN n USING (event_id) LEFT JOIN e f ON f.user_id = a.user_id AND f.p = a.p AND f.i <= a.i AND f.i > n.since GROUP BY 1, 2"""


def _sightings(e):
    return e.select("user_id", "ts", "event_id", (F.floor("value") % 6).alias("point"), (F.col("event_type") != "view").alias("kept"))


@query(_AGES)
def point_ages(spark, d):
    """How long a series' points have been kept, and how many there are."""
    return P.point_ages(_sightings(read(spark, d, "events")), "user_id", ["ts", "event_id"], "point", "kept").select("user_id", "event_id", "age", "points")


@query(_AGES)
def stream_point_ages(spark, d):
    """The same over a stream, with a map of points as Spark's state."""
    from ..streaming.run import drain

    out = P.stream_point_ages(_sightings(_stream(spark, d)), "user_id", ["ts", "event_id"], "point", "kept")
    return drain(out).select("user_id", "event_id", "age", "points")


# ---- folds of whole states


def _gate_sql(reliable: str, first: str) -> str:
    """The corner gate, a round a position: lq is the last accepted row."""
    near = [_near(c, 0.8) for c in ("top", "right", "bottom", "left")] + [_near("area", 0.9)]
    ok = " AND ".join([f'e."{c}" > 0 AND p."{c}" > 0' for c in ("top", "right", "bottom", "left")] + near)
    passed = f"{reliable.replace('#', 'e.')} AND (g.lq IS NULL OR ({ok}))"
    return f"""ed AS MATERIALIZED (SELECT * FROM edged), gate AS (
  SELECT vec_id, q, {first} AS ok, CASE WHEN {reliable.replace('#', '')} THEN q END AS lq FROM ed WHERE q = 0
  UNION ALL SELECT e.vec_id, e.q, {passed}, CASE WHEN {passed} THEN e.q ELSE g.lq END
  FROM gate g JOIN ed e ON e.vec_id = g.vec_id AND e.q = g.q + 1 LEFT JOIN ed p ON p.vec_id = g.vec_id AND p.q = g.lq)"""


_SOME = "((#vec_id + #q) % 3 <> 0)"


def _gated(spark, d, gate):
    rows = _quads(spark, d, ordered=False).select("vec_id", "q", ((F.col("vec_id") + F.col("q")) % 3 != 0).alias("reliable"), *_corner_columns(F.col("quad")))
    return D.fold(rows, "vec_id", ["q"], ["reliable", *_CORNERS], gate, "ok", "boolean").select("vec_id", "q", "ok")


@query(f"WITH RECURSIVE {_ORDERED}, {_EDGES}, {_gate_sql(_SOME, 'true')} SELECT vec_id, q, ok FROM gate")
def offline_geometry_gate(spark, d):
    """Against the last accepted row, not the row before; the first is true."""
    return _gated(spark, d, D.GeometryGate(0.8, 0.9))


@query(f"WITH RECURSIVE {_ORDERED}, {_EDGES}, {_gate_sql(_SOME, _SOME.replace('#', ''))} SELECT vec_id, q, ok FROM gate")
def probe_geometry_gate(spark, d):
    """The probe's gate: a first row counts as it is."""
    return _gated(spark, d, D.GeometryGate(0.8, 0.9, first_true=False))


_MEASURES = {"a": ("value", 2.0), "b": ("value * 0.5", 2.0), "c": ("(value - 50) / 100", 0.1), "s": ("1 + (value - 50) / 1000", 0.01)}


def _smoother_sql() -> str:
    held = lambda before, v, most: f"{before} + greatest(-{most}, least({most}, {before} * 0.8 + ({v}) * (1 - 0.8) - {before}))"
    rest = {"a": "0.0", "b": "0.0", "c": "0.0", "s": "1.0"}
    start = ", ".join(f"CAST(CASE WHEN ok THEN {held(rest[k], e, most)} ELSE {rest[k]} END AS DOUBLE) AS {k}" for k, (e, most) in _MEASURES.items())
    step = []
    for k, (e, most) in _MEASURES.items():
        step.append(f"CASE WHEN NOT o.ok THEN f.{k} ELSE {held(f'f.{k}', e.replace('value', 'o.value'), most)} END")
    state = ", ".join(f"CASE WHEN f.ok THEN {_r(f'f.{k}')} END AS {k}" for k in _MEASURES)
    return _recursive(state, f"ok, {start}", f"o.ok, {', '.join(step)}")


@query(_smoother_sql())
def residual_smoother(spark, d):
    """Four components averaged and held to their steps; rejected rows get none."""
    e = observations(spark, d).withColumns({k: F.when(F.col("ok"), F.expr(v)) for k, (v, _) in _MEASURES.items()})
    out = D.fold(e.select(*_ROW, *_MEASURES), "user_id", ["ts", "event_id"], list(_MEASURES), D.ResidualSmoother(0.8, 2.0, 0.1, 0.01), "m", "array<double>")
    return rounded(out.select("user_id", "event_id", *[F.col("m")[i].alias(k) for i, k in enumerate(_MEASURES)]))


_M = "CASE WHEN {0}ok THEN {0}value / 100 END"
_MISS = f"(NOT o.ok OR (f.s IS NOT NULL AND abs({_M.format('o.')} - f.s) > 0.9))"
_CLIP = "greatest(-2.0, least(2.0, {0}))"
_TO = _CLIP.format(f"f.s + greatest(-0.12, least(0.12, f.s * 0.8 + {_CLIP.format(_M.format('o.'))} * (1 - CAST(0.8 AS DOUBLE)) - f.s))")


@query(_recursive(f"{_r('s')} AS angle, u AS updates, m AS misses", f"{_CLIP.format(_M.format(''))} * CASE WHEN ok THEN 1 END AS s, CAST(ok AS BIGINT) AS u, CAST(NOT ok AS BIGINT) AS m", f"CASE WHEN {_MISS} THEN f.s WHEN f.s IS NULL THEN {_CLIP.format(_M.format('o.'))} ELSE {_TO} END, f.u + CAST(NOT {_MISS} AS BIGINT), f.m + CAST({_MISS} AS BIGINT)"))
def line_roll_counts(spark, d):
    """The followed roll angle with its updates and misses."""
    e = observations(spark, d).withColumn("angle_in", F.when(F.col("ok"), F.col("value") / 100))
    out = D.fold(e.select(*_ROW, "angle_in"), "user_id", ["ts", "event_id"], ["angle_in"], D.LineRollDriver(D.LineRoll(2.0, 0.8, 0.12, 0.9)), "s", "array<double>")
    return rounded(out.select("user_id", "event_id", F.col("s")[0].alias("angle"), F.col("s")[1].cast("long").alias("updates"), F.col("s")[2].cast("long").alias("misses")))


# ---- smoothed trajectories


def _long_sql(source: str, columns: list[str]) -> str:
    return f"v0 AS (SELECT vec_id, q, c, v FROM {source} UNPIVOT INCLUDE NULLS (v FOR c IN ({', '.join(columns)})))"


def _filtered(name: str, source: str, how: str) -> str:
    """A centred window of three, edges repeated, over rows 0 to 7."""
    return f"{name} AS (SELECT a.vec_id, a.q, a.c, {how} AS v FROM {source} a CROSS JOIN range(-1, 2) k(o) JOIN {source} b ON b.vec_id = a.vec_id AND b.c = a.c AND b.q = greatest(0, least(7, a.q + k.o)) GROUP BY a.vec_id, a.q, a.c)"


def _wide_sql(source: str) -> str:
    """Corner columns x0 ... y3 of a long table, ordered anew."""
    cols = ", ".join(f"max(v) FILTER (WHERE c = '{c}') AS {'xy'[k % 2]}{k // 2}" for k, c in enumerate(_CORNERS))
    keys = {c: "[" + ", ".join(e.format(x=f"x{i}", y=f"y{i}") for i in range(4)) + "]" for c, (_, e) in _PICK.items()}
    at = ", ".join(f"list_position({k}, {_PICK[c][0]}({k})) AS p_{c}" for c, k in keys.items())
    out = ", ".join(f"[{a}0, {a}1, {a}2, {a}3][p_{c}] AS {c}_{a}" for c in _PICK for a in "xy")
    return f"wide AS (SELECT vec_id, q, {cols} FROM {source} GROUP BY vec_id, q), pos2 AS (SELECT *, {at} FROM wide), again AS (SELECT vec_id, q, {out} FROM pos2)"


_SMOOTH = f"{_filtered('v1', 'v0', 'median(b.v)')}, {_filtered('v2', 'v1', 'avg(b.v)')}, {_wide_sql('v2')}"


@query(f"WITH {_ORDERED}, {_long_sql('ordered', _CORNERS)}, {_SMOOTH} SELECT vec_id, q, {', '.join(f'{_r(c)} AS {c}' for c in _CORNERS)} FROM again")
def smooth_corner_trajectory(spark, d):
    """Median and mean of all eight coordinates, corners ordered anew."""
    rows = _quads(spark, d).select("vec_id", "q", *_corner_columns(F.col("quad")))
    return rounded(smooth_corners(rows, Series("vec_id", "q"), _CORNERS, 3, 3))


_PARTS = "parts AS (SELECT vec_id, q, tx, ty, degrees(atan2(c, a)) AS rot, (sqrt(a * a + c * c) + sqrt(b * b + d * d)) / 2 AS scale FROM m)"
_TURN = ", ".join(f"max(v) FILTER (WHERE c = '{c}') AS {c}" for c in ("tx", "ty", "rot", "scale"))


@query(f"WITH {_QUADS}, {_AFFINE}, {_PARTS}, {_long_sql('parts', ['tx', 'ty', 'rot', 'scale'])}, {_filtered('v1', 'v0', 'median(b.v)')}, {_filtered('v2', 'v1', 'avg(b.v)')}, w AS (SELECT vec_id, q, {_TURN} FROM v2 GROUP BY vec_id, q) SELECT vec_id, q, {_r('cos(radians(rot)) * scale')} AS h0, {_r('-(sin(radians(rot)) * scale)')} AS h1, {_r('tx')} AS h2, {_r('ty')} AS h5 FROM w")
def smooth_residual_trajectory(spark, d):
    """Transforms taken apart, smoothed and put together."""
    out = smooth_residual(_affines(spark, d), Series("vec_id", "q"), "h", 3, 3)
    return rounded(out.select("vec_id", "q", *[F.col("h")[k].alias(f"h{k}") for k in (0, 1, 2, 5)]))


_TOLD = "(#q = 0 OR (#vec_id + #q) % 3 <> 0)"
_HELD = """lh AS (SELECT a.vec_id, a.q, max(b.q) FILTER (WHERE b.ok AND b.q <= a.q) AS lo, min(b.q) FILTER (WHERE b.ok AND b.q >= a.q) AS hi FROM gate a JOIN gate b USING (vec_id) GROUP BY a.vec_id, a.q),
raw AS (SELECT vec_id, q, c, v FROM ordered UNPIVOT (v FOR c IN ({cols}))),
v0 AS (SELECT lh.vec_id, lh.q, l.c, CASE WHEN hi IS NULL OR hi = lo THEN l.v ELSE l.v + (h.v - l.v) * (CAST(lh.q - lo AS DOUBLE) / (hi - lo)) END AS v
  FROM lh JOIN raw l ON l.vec_id = lh.vec_id AND l.q = lh.lo LEFT JOIN raw h ON h.vec_id = lh.vec_id AND h.q = lh.hi AND h.c = l.c)""".format(cols=", ".join(_CORNERS))


@query(f"WITH RECURSIVE {_ORDERED}, {_EDGES}, {_gate_sql(_TOLD, 'true')}, {_HELD}, {_SMOOTH} SELECT CAST(vec_id AS VARCHAR) AS video, q AS frame, gate.ok AS reliable, {', '.join(f'{_r(f'again.{c}')} AS smoothed_{c}' for c in _CORNERS)} FROM again JOIN gate USING (vec_id, q)")
def refined_trajectory(spark, d):
    """The whole offline plan: reliability, gate, interpolation, smoothing."""
    from .trajectory import refine

    raw = _quads(spark, d).select(F.col("vec_id").cast("string").alias("video"), F.col("q").alias("frame"), *_corner_columns(F.col("quad")))
    videos = raw.groupBy("video").agg(F.count(F.lit(1)).alias("frame_count"))
    rejected = (F.col("video").cast("long") + F.col("frame")) % 3 == 0
    told = raw.filter(rejected).select("video", "frame", F.lit(False).alias("accepted"), F.lit(2).alias("seq"))
    told = told.unionByName(told.withColumns({"accepted": F.lit(True), "seq": F.lit(1)}))
    out = refine(raw, videos, told, Config(median_window=3, mean_window=3, scale_step=0.8, area_step=0.9))
    return rounded(out.select("video", "frame", "reliable", *[f"smoothed_{c}" for c in _CORNERS]))
