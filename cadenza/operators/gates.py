"""Quality gates: ordered predicates of which the first that fails names the
reason, each compiled to one CASE expression. A threshold of zero or less
switches a gate off where `optional` says so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(steps: list[tuple[str, Column]], passed: str) -> Column:
    """The name of the first step whose predicate holds, else `passed`."""
    out = None
    for name, fails in steps:
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return F.lit(passed) if out is None else out.otherwise(passed)


def _c(x) -> Column:
    return F.lit(x) if isinstance(x, bool) else F.col(x) if isinstance(x, str) else x


# The gates' default thresholds and the order of their reasons.
@dataclass(frozen=True)
class TrackerGates:
    mature_points: int = 20
    inliers: int = 40
    inlier_ratio: float = 0.25
    reprojection_error: float = 2.5
    coverage_x: float = 0.25
    coverage_y: float = 0.20

    def reason(self, mature="mature_valid_count", has_transform=True, inliers="inlier_count", ratio="inlier_ratio", error="reprojection_error", cov_x="coverage_x", cov_y="coverage_y", geometry_ok=True) -> Column:
        """The reprojection error is always compared, even with zero."""
        return cascade(
            [
                ("not_enough_mature_points", _c(mature) < self.mature_points),
                ("homography_failed", ~_c(has_transform)),
                ("not_enough_inliers", _c(inliers) < self.inliers),
                ("low_inlier_ratio", _c(ratio) < self.inlier_ratio),
                ("high_reprojection_error", _c(error) > self.reprojection_error),
                ("low_coverage_x", _c(cov_x) < self.coverage_x),
                ("low_coverage_y", _c(cov_y) < self.coverage_y),
                ("invalid_geometry", ~_c(geometry_ok)),
            ],
            "accepted",
        )


@dataclass(frozen=True)
class AlignGates:
    inliers: int = 80
    inlier_ratio: float = 0.60
    coverage_x: float = 0.25
    coverage_y: float = 0.20
    reprojection_error: float = 1.0
    translation: float = 12.0
    rotation: float = 0.50
    scale_delta: float = 0.010

    def reason(self, inliers="inlier_count", ratio="inlier_ratio", cov_x="coverage_x", cov_y="coverage_y", error="reprojection_error", translation="translation_px", rotation="rotation_deg", scale_delta="scale_delta") -> Column:
        """The last four are off at zero."""
        steps = [
            ("too_few_inliers", _c(inliers) < self.inliers),
            ("low_inlier_ratio", _c(ratio) < self.inlier_ratio),
            ("low_coverage_x", _c(cov_x) < self.coverage_x),
            ("low_coverage_y", _c(cov_y) < self.coverage_y),
        ]
        optional = [
            ("high_reprojection_error", _c(error), self.reprojection_error),
            ("large_translation", _c(translation), self.translation),
            ("large_rotation", F.abs(_c(rotation)), self.rotation),
            ("large_scale_delta", F.abs(_c(scale_delta)), self.scale_delta),
        ]
        return cascade(steps + [(n, v > most) for n, v, most in optional if most > 0], "accepted")

    @staticmethod
    def early_reason(reference_points: Column, flowed: Column, backflowed: Column, valid: Column, estimated: Column, inliers: Column, motion: str = "homography", least: int = 20) -> Column:
        """Failures before there is a transform to judge; null if none."""
        steps = [
            ("not_enough_reference_points", reference_points < least),
            ("flow_failed", ~flowed),
            ("backflow_failed", ~backflowed),
            ("not_enough_valid_points", valid < least),
            (f"{motion}_failed", ~estimated),
            ("too_few_inliers", inliers < least),
        ]
        return F.nullif(cascade(steps, ""), F.lit(""))


@dataclass(frozen=True)
class LearnedGates:
    matches: int = 40
    inliers: int = 30
    inlier_ratio: float = 0.25
    coverage_x: float = 0.20
    coverage_y: float = 0.15
    reprojection_error: float = 4.0

    def reason(self, matches="match_count", has_transform=True, inliers="inlier_count", ratio="inlier_ratio", error="reprojection_error", cov_x="coverage_x", cov_y="coverage_y", corners_ok=True, step_ok=True) -> Column:
        return cascade(
            [
                ("not_enough_matches", _c(matches) < self.matches),
                ("homography_failed", ~_c(has_transform)),
                ("not_enough_inliers", _c(inliers) < self.inliers),
                ("low_inlier_ratio", _c(ratio) < self.inlier_ratio),
                ("high_reprojection_error", _c(error) > self.reprojection_error),
                ("low_coverage_x", _c(cov_x) < self.coverage_x),
                ("low_coverage_y", _c(cov_y) < self.coverage_y),
                ("invalid_corners", ~_c(corners_ok)),
                ("large_geometry_step", ~_c(step_ok)),
            ],
            "ok",
        )


def pair_reason(features: Column, flowed: Column, tracked: Column, estimated: Column, least: int = 30) -> Column:
    return cascade(
        [
            ("not_enough_features", features < least),
            ("flow_failed", ~flowed),
            ("not_enough_tracked_points", tracked < least),
            ("affine_failed", ~estimated),
        ],
        "ok",
    )


def flow_consistent(forward: Column, backward: Column, drift: Column, most: float) -> Column:
    """Both directions found and the round trip ends within `most` pixels."""
    return forward & backward & (drift < most)


def mature(valid: Column, age: Column, least: int = 15) -> Column:
    """Points tracked well and long enough to be fitted."""
    return valid & (age >= least)


def keep_after_accept(error: Column, most_error: float) -> Column:
    return error <= max(3.0, 1.5 * most_error)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(n: Column, d: Column) -> Column:
    return n / F.greatest(F.lit(1), d)


def in_last_seconds(time: Column, duration: Column, seconds: float) -> Column:
    return time >= F.greatest(F.lit(0.0), duration - seconds)


def line_candidate_ok(length: Column, angle: Column, width, most_angle: float, least: int = 140, share: int = 10) -> Column:
    return (length >= F.greatest(F.lit(least), F.floor(F.lit(width) / share))) & (F.abs(angle) <= most_angle)


def frames_the_picture(box: Column, width, height) -> Column:
    """A box of struct x0, y0, x1, y1 (ends exclusive) that comes within a pixel
    of an edge and is over nine tenths as wide or as high as the picture."""
    w, h = F.lit(width) if isinstance(width, int) else width, F.lit(height) if isinstance(height, int) else height
    touches = (box["x0"] <= 1) | (box["y0"] <= 1) | (box["x1"] >= w - 1) | (box["y1"] >= h - 1)
    return touches & ((box["x1"] - box["x0"] > w * 0.9) | (box["y1"] - box["y0"] > h * 0.9))


def component_ok(area: Column, box: Column, width: Column, height: Column, intersects: Column, long: Column, short: Column, fill: Column, aspect: Column, angle: Column, least_long, least_short, most_angle: float, least_area: float = 0.002) -> Column:
    """A connected component that can be a text line or edge."""
    framing = frames_the_picture(box, width, height)
    sized = (area >= least_area * width * height) & (long >= least_long) & (short >= least_short)
    return sized & intersects & ~framing & (fill >= 0.35) & (aspect >= 1.2) & (F.abs(angle) <= most_angle)


def boxes_intersect(a: Column, b: Column) -> Column:
    """Of structs x0, y0, x1, y1, ends exclusive."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def out_of_range(requested: DataFrame, videos: DataFrame) -> DataFrame:
    """Requested (video, frame) rows that their video doesn't have."""
    known = videos.select("video", "frame_count")
    joined = requested.join(known, "video", "left")
    return joined.filter(F.col("frame_count").isNull() | (F.col("frame") < 0) | (F.col("frame") >= F.col("frame_count")))
