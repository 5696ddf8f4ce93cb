"""The offline refinement of a corner trajectory, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import order_corners, point
from ..operators.folds import GeometryGate, fold
from ..operators.joins import reliability_spine
from ..operators.timeseries import Series, smooth_corners
from ..sources.schemas import CORNERS
from .config import Config


def refine(raw: DataFrame, videos: DataFrame, tracker: DataFrame, config: Config | None = None) -> DataFrame:
    """raw(video, frame, eight corner columns) with reliable and the
    interpolated and smoothed corners: reliability from the tracker rows, the
    sequential geometry gate, interpolation over rejected frames (its corners
    ordered again), smoothing."""
    config = config or Config()
    rows = raw.join(reliability_spine(videos, tracker), ["video", "frame"])
    if config.offline_gate:
        rows = fold(rows, "video", ["frame"], ["reliable", *CORNERS], GeometryGate(config.scale_step, config.area_step), "__ok", "boolean")
        rows = rows.withColumn("reliable", F.col("__ok")).drop("__ok")
    s = Series("video", "frame")
    rows = rows.withColumns({f"raw_{c}": F.col(c) for c in CORNERS})
    if config.interpolate:
        rows = rows.withColumns({f"__{c}": s.interpolate(F.col(f"raw_{c}"), F.col("reliable"), F.col("frame")) for c in CORNERS})
        rows = rows.withColumn("__quad", order_corners(F.array(*[point(F.col(f"__{x}"), F.col(f"__{y}")) for x, y in zip(CORNERS[::2], CORNERS[1::2], strict=True)])))
        rows = rows.withColumns({f"interpolated_{c}": F.col("__quad")[k // 2]["xy"[k % 2]] for k, c in enumerate(CORNERS)}).drop("__quad", *[f"__{c}" for c in CORNERS])
    else:
        rows = rows.withColumns({f"interpolated_{c}": F.col(f"raw_{c}") for c in CORNERS})
    smoothed = [f"smoothed_{c}" for c in CORNERS]
    rows = rows.withColumns({n: F.col(f"interpolated_{c}") for n, c in zip(smoothed, CORNERS, strict=True)})
    rows = smooth_corners(rows, s, smoothed, config.median_window, config.mean_window)
    return rows.select("video", "frame", "reliable", *[f"{k}_{c}" for k in ("raw", "interpolated", "smoothed") for c in CORNERS])


def global_switch(rows: DataFrame, accepted: str = "accepted", least: float = 0.90, key: str = "video") -> DataFrame:
    """Whole-series accept ratio beside each row, and whether it reaches
    `least`."""
    ratio = Series(key, key).accept_ratio(F.col(accepted))
    return rows.withColumn("global_accept_ratio", ratio).withColumn("global_enabled", F.col("global_accept_ratio") >= least)
