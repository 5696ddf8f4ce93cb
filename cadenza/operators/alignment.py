"""Residual alignment: what movement is left between a rectified video's first
frame and each later one. Points of the first frame are followed with a backward
check and give a transform from the current frame to the reference, judged by
ordered gates. A rejected frame keeps the transform before it; whole series are
then smoothed (timeseries.smooth_residual) and switched on or off by their accept
ratio (plans.trajectory.global_switch)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.schemas import COMPONENTS
from . import vision as V
from .gates import AlignGates

# Points, their least number, flow window and levels, round trip, fit.
MOST_POINTS, QUALITY, APART, LEAST = 1200, 0.004, 9.0, 20
WINDOW, LEVELS, ROUND_TRIP, FIT_ERROR = 41, 4, 1.5, 2.0


def reference_points(image: np.ndarray) -> np.ndarray | None:
    """Corners away from the border; None if they are too few."""
    h, w = image.shape
    y, x = max(20, h // 50), max(20, w // 50)
    mask = np.zeros(image.shape, bool)
    mask[y : h - y, x : w - x] = True
    points = V.corner_points(image, mask, MOST_POINTS, QUALITY, APART)
    return points if len(points) >= LEAST else None


def motion_of(h: np.ndarray | None) -> dict[str, float]:
    if h is None:
        return dict.fromkeys(COMPONENTS, float("nan"))
    sx, sy = float(np.hypot(h[0, 0], h[1, 0])), float(np.hypot(h[0, 1], h[1, 1]))
    values = (h[0, 2], h[1, 2], np.degrees(np.arctan2(h[1, 0], h[0, 0])), sx, sy, (sx + sy) / 2, h[2, 0], h[2, 1])
    return dict(zip(COMPONENTS, map(float, values), strict=True))


def coverage(points: np.ndarray, shape: tuple[int, int]) -> tuple[float, float]:
    """p95 - p05 of the points as shares of the picture's width and height."""
    low, high = np.percentile(points, (5, 95), axis=0)
    spread = np.maximum(high - low, 0)
    return float(spread[0] / max(1, shape[1])), float(spread[1] / max(1, shape[0]))


def reason_of(row: dict, gates: AlignGates) -> str:
    """The gates' first failure, in their order; the last four are off at zero."""
    checks = [
        ("too_few_inliers", row["inlier_count"] < gates.inliers),
        ("low_inlier_ratio", row["inlier_ratio"] < gates.inlier_ratio),
        ("low_coverage_x", row["coverage_x"] < gates.coverage_x),
        ("low_coverage_y", row["coverage_y"] < gates.coverage_y),
    ]
    moved = np.hypot(row["translation_x"], row["translation_y"])
    for name, value, most in (
        ("high_reprojection_error", row["reprojection_error"], gates.reprojection_error), ("large_translation", moved, gates.translation),
        ("large_rotation", abs(row["rotation_deg"]), gates.rotation), ("large_scale_delta", abs(row["scale_avg"] - 1), gates.scale_delta),
    ):
        checks.append((name, most > 0 and value > most))
    return next((name for name, fails in checks if fails), "accepted")


def align(reference: np.ndarray, image: np.ndarray, points: np.ndarray | None, motion: str, gates: AlignGates) -> tuple[np.ndarray | None, dict]:
    """(transform or None, the alignment table's row)."""
    row = {"motion": motion, "reference_point_count": 0 if points is None else len(points), "valid_count": 0, "inlier_count": 0}
    row |= {"inlier_ratio": 0.0, "coverage_x": 0.0, "coverage_y": 0.0, "reprojection_error": float("inf")} | motion_of(None)

    def failed(reason: str):
        return None, row | {"accepted": False, "reason": reason}

    if points is None or len(points) < LEAST:
        return failed("not_enough_reference_points")
    to, there = V.track(reference, image, points, WINDOW, LEVELS)
    if not there.any():
        return failed("flow_failed")
    back, again = V.track(image, reference, to, WINDOW, LEVELS)
    if not again.any():
        return failed("backflow_failed")
    valid = there & again & (np.hypot(*(points - back).T) < ROUND_TRIP)
    row["valid_count"] = int(valid.sum())
    if valid.sum() < LEAST:
        return failed("not_enough_valid_points")
    fit, size = (V.fit_homography, 4) if motion == "homography" else (V.fit_similarity, 2)
    now, then = to[valid], points[valid]
    h, inside = V.ransac(now, then, fit, size, FIT_ERROR, rounds=300)
    if h is None:
        return failed(f"{motion}_failed")
    if inside.sum() < LEAST:
        return failed("too_few_inliers")
    spread = coverage(then[inside], image.shape)
    row |= {
        "inlier_count": int(inside.sum()), "inlier_ratio": float(inside.sum() / max(1, valid.sum())),
        "coverage_x": spread[0], "coverage_y": spread[1],
        "reprojection_error": float(np.median(np.hypot(*(V.apply(h, now[inside]) - then[inside]).T))),
    } | motion_of(h)
    row["reason"] = reason_of(row, gates)
    row["accepted"] = row["reason"] == "accepted"
    return (h if row["accepted"] else None), row


@dataclass
class Aligner:
    """One video's state: the reference and the transform in force."""

    motion: str = "affine"
    gates: AlignGates = field(default_factory=AlignGates)
    reference: np.ndarray | None = None
    points: np.ndarray | None = None
    held: np.ndarray = field(default_factory=lambda: np.eye(3))

    def step(self, image: np.ndarray) -> dict:
        if self.reference is None:
            self.reference, self.points = image, reference_points(image)
            n = 0 if self.points is None else len(self.points)
            spread = coverage(self.points, image.shape) if n else (0.0, 0.0)
            row = {"motion": self.motion, "reference_point_count": n, "valid_count": n, "inlier_count": n, "inlier_ratio": float(n > 0), "coverage_x": spread[0], "coverage_y": spread[1]}
            row |= {"reprojection_error": 0.0, "accepted": True, "reason": "reference_frame"} | motion_of(self.held)
        else:
            h, row = align(self.reference, image, self.points, self.motion, self.gates)
            self.held = self.held if h is None else h
        return row | {"transform": self.held.reshape(-1)}


ALIGNED = (
    "video string, frame int, accepted boolean, reason string, motion string, reference_point_count int, valid_count int, inlier_count int, inlier_ratio double, coverage_x double, "
    "coverage_y double, reprojection_error double, " + ", ".join(f"{c} double" for c in COMPONENTS) + ", transform array<double>"
)


def residual_alignment(frames: DataFrame, motion: str = "affine", gates: AlignGates | None = None) -> DataFrame:
    """Alignment rows of frames(video, frame, height, width, channels, data) with
    the transform in force at each; frames are streamed in order, a task holds
    one state and one frame."""
    columns = [c.split()[0] for c in ALIGNED.split(", ")]
    rules = gates or AlignGates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if state is None or r.video != name:
                    name, state = r.video, Aligner(motion, rules)
                image = V.gray(V.to_array(r.data, r.height, r.width, r.channels))
                rows.append({"video": r.video, "frame": r.frame} | state.step(image))
            yield pd.DataFrame(rows, columns=columns)

    return frames.repartition("video").sortWithinPartitions("video", "frame").mapInPandas(run, ALIGNED)
