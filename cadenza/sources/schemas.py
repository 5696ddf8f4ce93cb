"""Explicit schemas of the measurement tables, and reader options. Nothing is
inferred: a file with unknown columns loses them, a missing one reads as null."""

from pyspark.sql import types as T

# Column names and orders of the tables that are exchanged.
_D, _I, _S, _B = T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType()
CORNERS = [f"{c}_{a}" for c in ("tl", "tr", "br", "bl") for a in ("x", "y")]
COMPONENTS = ["translation_x", "translation_y", "rotation_deg", "scale_x", "scale_y", "scale_avg", "perspective_x", "perspective_y"]



def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for names, t in pairs for n in (names.split() if isinstance(names, str) else names)])


VIDEOS = _fields(("video", _S), ("width height", _I), ("fps", _D), ("frame_count", _I))
FRAMES = _fields(("video", _S), ("frame height width channels", _I), ("data", T.BinaryType()))
TRACKER = _fields(
    ("frame", _I), ("accepted", _B), ("reason", _S), ("point_count mature_point_count valid_count mature_valid_count inlier_count", _I),
    ("inlier_ratio reprojection_error coverage_x coverage_y", _D), ("rejected_updates", _I),
    ("area center_x center_y top_edge right_edge bottom_edge left_edge", _D), (CORNERS, _D),
)
TRAJECTORY = _fields(("frame", _I), ("reliable", _B), ([f"{s}_{c}" for s in ("raw", "interpolated", "smoothed") for c in CORNERS], _D))
ALIGN = _fields(
    ("frame", _I), ("accepted", _B), ("reason motion", _S), ("reference_point_count valid_count inlier_count", _I),
    ("inlier_ratio coverage_x coverage_y reprojection_error", _D), (COMPONENTS, _D), ([f"applied_{c}" for c in COMPONENTS], _D),
    ("global_accept_ratio", _D), ("global_enabled", _B),
)
STABILITY = _fields(
    ("video", _S), ("frame", _I), ("time_seconds", _D), ("ok", _B), ("reason", _S), ("feature_count tracked_count inlier_count", _I),
    ("inlier_ratio inlier_coverage_x inlier_coverage_y translation_x_px translation_y_px translation_px rotation_deg scale scale_delta", _D),
)
LINE_ROLL = _fields(("frame raw_candidates same_direction_inliers", _I), ("dominant_angle_deg accepted_angle_deg total_inlier_length_px", _D), ("accepted", _B))
LEARNED = _fields(
    ("sample frame", _I), ("time_seconds", _D), ("accepted", _B), ("reason", _S), ("match_count inlier_count", _I),
    ("inlier_ratio reprojection_error coverage_x coverage_y runtime_seconds center_x center_y", _D), (CORNERS, _D),
)
EXPERIMENTS = _fields(
    ("scenario video method normalize_run analysis_run", _S), ("translation_p95 rotation_p95 scale_delta_p95 rejected_tracker_frames median_tracker_inliers median_tracker_inlier_ratio", _D),
    ("interpretation", _S),
)
ABLATION = _fields(("method video_path summary_path", _S), ("translation_p95_all_px translation_p95_last2s_px rotation_p95_all_deg rotation_p95_last2s_deg scale_delta_p95_all scale_delta_p95_last2s", _D))
_FRAME = T.StructType([T.StructField("frame", _I), T.StructField("time_seconds", _D), T.StructField("corners", T.ArrayType(T.ArrayType(_D)))])
ANNOTATIONS = T.StructType(
    [
        T.StructField("generated_at", _S),
        T.StructField("video", _S),
        T.StructField("output_size", _fields(("width height", _I))),
        T.StructField("frames", T.ArrayType(_FRAME)),
    ]
)
_METRIC = T.StructType([T.StructField(n, _D) for n in ("mean", "p95", "max")])
METRICS = ("translation_px", "rotation_abs_deg", "scale_delta_abs", "inlier_ratio", "inlier_coverage_x", "inlier_coverage_y")
_SUMMARY = T.StructType([T.StructField("pairs", _I), T.StructField("ok_pairs", _I), *[T.StructField(m, _METRIC) for m in METRICS]])
SUMMARY = T.StructType(
    [
        T.StructField("generated_at", _S),
        T.StructField("summary", T.ArrayType(T.StructType([T.StructField("video", VIDEOS), T.StructField("all", _SUMMARY), T.StructField("last_seconds", _SUMMARY)]))),
    ]
)

#: CSV as Python writes it: nan, inf and True/False.
CSV_OPTIONS = {"header": True, "nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf", "enforceSchema": False}
EXPERIMENT_OPTIONS = CSV_OPTIONS | {"nullValue": "n/a"}
