"""Trackers and line detectors over raw frames.

A video's frames are dealt to one task, sorted, and streamed through a state
machine: memory is one state and one frame, whatever the video's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Config
from . import vision as V
from .aggregates import dominant_direction
from .folds import GeometryGate, quad_measures

# Least points of a fit, points taken on, points below which they are
# renewed, their distance, fit and keep errors in reference pixels, round trip, flow window.
LEAST_POINTS, NEW_POINTS, FEW_POINTS, APART = 20, 250, 140, 8.0
FIT_ERROR, KEEP_ERROR, KEEP_FACTOR, ROUND_TRIP, WINDOW = 3.0, 3.0, 1.5, 2.0, 31


def order_corners(points: np.ndarray) -> np.ndarray:
    s, d = points.sum(1), points[:, 1] - points[:, 0]
    return points[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]


def quad_is_valid(quad: np.ndarray, width: int, height: int) -> bool:
    top, right, bottom, left, area = quad_measures(tuple(quad.reshape(-1)))
    tall = (left + right) / 2
    return 0.20 <= area / (width * height) <= 0.85 and tall > 0 and 1.25 <= (top + bottom) / 2 / tall <= 2.35


def unit_coverage(points: np.ndarray, quad: np.ndarray) -> tuple[float, float]:
    """p95 - p05 of the points' places in the quad as a unit square."""
    if len(points) < 2:
        return 0.0, 0.0
    unit = V.apply(V.fit_homography(quad, np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)), points)
    low, high = np.percentile(unit, (5, 95), axis=0)
    return tuple(np.maximum(high - low, 0).tolist())


def apart(new: np.ndarray, known: np.ndarray, distance: float) -> np.ndarray:
    """New points no known point is nearer to than `distance`."""
    if not len(new) or not len(known):
        return new
    keep = [(np.hypot(*(known - p).T) >= distance).all() for p in new]
    return new[np.array(keep, bool)]


class ReferenceTracker:
    """Every frame against the first: points found there are followed with a
    backward check; those old enough give a homography, which is judged by the
    tracker's gates. Points are renewed after accepted frames only."""

    def __init__(self, config: Config, quad: np.ndarray):
        self.config, self.reference_quad = config, order_corners(np.asarray(quad, float))
        self.gate = GeometryGate(config.scale_step, config.area_step)
        self.quad, self.before, self.number, self.rejected = self.reference_quad, None, 0, 0
        self.last = quad_measures(tuple(self.quad.reshape(-1)))

    def _find(self, image: np.ndarray, quad: np.ndarray) -> np.ndarray:
        margin = min(12.0, 0.1 * min(self.last[:4]))
        return V.corner_points(image, V.convex_mask(quad, image.shape, margin))

    def step(self, image: np.ndarray) -> dict:
        row = {"point_count": 0, "mature_point_count": 0, "valid_count": 0, "mature_valid_count": 0, "inlier_count": 0, "inlier_ratio": 0.0, "reprojection_error": float("inf"), "coverage_x": 0.0, "coverage_y": 0.0}
        if self.before is None:
            self.now = self._find(image, self.quad)
            self.origin, self.age = self.now.copy(), np.full(len(self.now), self.config.least_point_age)
            reason = "initial_reference"
        else:
            reason = self._follow(image, row)
        row["point_count"] = row["point_count"] or len(self.now)
        accepted = reason in ("accepted", "initial_reference")
        self.before, self.number = image, self.number + 1
        return row | self._shape() | {"accepted": accepted, "reason": reason, "rejected_updates": self.rejected}

    def _shape(self) -> dict:
        top, right, bottom, left, area = quad_measures(tuple(self.quad.reshape(-1)))
        center = self.quad.mean(0)
        out = {"area": area, "center_x": center[0], "center_y": center[1], "top_edge": top, "right_edge": right, "bottom_edge": bottom, "left_edge": left}
        return out | {f"{c}_{a}": float(self.quad[i][j]) for i, c in enumerate(("tl", "tr", "br", "bl")) for j, a in enumerate("xy")}

    def _follow(self, image: np.ndarray, row: dict) -> str:
        c = self.config
        row["point_count"], row["mature_point_count"] = len(self.now), int((self.age >= c.least_point_age).sum())
        to, there = V.track(self.before, image, self.now, WINDOW) if len(self.now) else (self.now, np.zeros(0, bool))
        if not there.any():
            return "flow_failed"
        back, again = V.track(image, self.before, to, WINDOW)
        if not again.any():
            return "backflow_failed"
        valid = there & again & (np.hypot(*(back - self.now).T) < ROUND_TRIP)
        mature = valid & (self.age >= c.least_point_age)
        row["valid_count"], row["mature_valid_count"] = int(valid.sum()), int(mature.sum())
        h, reason = None, "not_enough_mature_points"
        if mature.sum() >= LEAST_POINTS:
            h, inside = V.ransac(to[mature], self.origin[mature], V.fit_homography, 4, FIT_ERROR, rounds=200)
            reason = "homography_failed" if h is None else self._judged(h, self.origin[mature][inside], to[mature][inside], int(mature.sum()), image.shape, row)
        if reason == "accepted":
            error = np.hypot(*(V.apply(h, to) - self.origin).T)
            keep = valid & (error <= max(KEEP_ERROR, KEEP_FACTOR * c.most_reprojection_error))
            self.quad = self._seen(h)
            self.last = quad_measures(tuple(self.quad.reshape(-1)))
            self.origin, self.now, self.age = self.origin[keep], to[keep], self.age[keep] + 1
            if len(self.now) < FEW_POINTS or self.number % c.feature_refresh == 0:
                self._renew(image, h)
        else:
            self.rejected += h is not None
            self.origin, self.now, self.age = self.origin[valid], to[valid], self.age[valid]
        return reason

    def _seen(self, h: np.ndarray) -> np.ndarray:
        """The reference quad in the current frame; h leads to the reference."""
        return order_corners(V.apply(np.linalg.inv(h), self.reference_quad))

    def _judged(self, h, origin, to, mature: int, shape, row: dict) -> str:
        c, n = self.config, len(origin)
        error = float(np.median(np.hypot(*(V.apply(h, to) - origin).T))) if n else float("inf")
        cov = unit_coverage(origin, self.reference_quad)
        quad = self._seen(h)
        row |= {"inlier_count": n, "inlier_ratio": n / max(1, mature), "reprojection_error": error, "coverage_x": cov[0], "coverage_y": cov[1]}
        steps = self.gate.steps_ok(quad_measures(tuple(quad.reshape(-1))), self.last)
        checks = [
            ("not_enough_inliers", n < c.least_inliers),
            ("low_inlier_ratio", row["inlier_ratio"] < c.least_inlier_ratio),
            ("high_reprojection_error", error > c.most_reprojection_error),
            ("low_coverage_x", cov[0] < c.least_coverage_x),
            ("low_coverage_y", cov[1] < c.least_coverage_y),
            ("invalid_geometry", not (steps and quad_is_valid(quad, shape[1], shape[0]))),
        ]
        return next((name for name, fails in checks if fails), "accepted")

    def _renew(self, image: np.ndarray, h: np.ndarray) -> None:
        fresh = apart(self._find(image, self.quad), self.now, APART)[:NEW_POINTS]
        if len(fresh):
            self.origin = np.vstack((self.origin, V.apply(h, fresh)))
            self.now = np.vstack((self.now, fresh))
            self.age = np.append(self.age, np.zeros(len(fresh), int))


class FlowTracker:
    """Frame to frame: the quad moves with a homography of points followed in
    it, is drawn towards a detection, and falls back to detection or rest."""

    def __init__(self, config: Config, quad: np.ndarray | None = None, detect: bool = True):
        self.config, self.detect = config, detect
        self.quad = None if quad is None else order_corners(np.asarray(quad, float))
        self.before, self.points, self.number = None, np.zeros((0, 2)), 0

    def step(self, frame: np.ndarray) -> dict:
        image = V.gray(frame)
        found = V.detect_screen(frame) if self.detect else None
        moved, inliers = self._predict(image)
        k, s = self.config.detect_correction, self.config.smooth
        if self.quad is None:
            now = found
        elif moved is not None:
            now = moved if found is None else moved * (1 - k) + found * k
        else:
            now = found if found is not None else self.quad
        if self.quad is not None and now is not None and s > 0:
            now = self.quad * s + now * (1 - s)
        self.quad = now
        stale = moved is None or len(self.points) < 80 or inliers < 60 or self.number % self.config.feature_refresh == 0
        if now is not None and stale:
            self.points = V.corner_points(image, V.convex_mask(now, image.shape, 4.0))
        self.before, self.number = image, self.number + 1
        return {"predicted": moved is not None, "detected": found is not None, "inlier_count": inliers, "corners": None if now is None else now.reshape(-1)}

    def _predict(self, image: np.ndarray) -> tuple[np.ndarray | None, int]:
        if self.before is None or self.quad is None or len(self.points) < 12:
            return None, 0
        to, there = V.track(self.before, image, self.points, WINDOW)
        back, again = V.track(image, self.before, to, WINDOW)
        ok = there & again & (np.hypot(*(back - self.points).T) < ROUND_TRIP)
        if ok.sum() < 12:
            return None, 0
        h, inside = V.ransac(self.points[ok], to[ok], V.fit_homography, 4, FIT_ERROR, rounds=200)
        self.points = to[ok]
        if h is None or inside.sum() < 12:
            return None, int(inside.sum())
        quad = V.apply(h, self.quad)
        self.points = to[ok][inside]
        return (quad if quad_is_valid(quad, image.shape[1], image.shape[0]) else None), int(inside.sum())


def _streamed(frames: DataFrame, schema: str, start, step) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.video != name:
                    name, state = r.video, start(r)
                rows.append({"video": r.video, "frame": r.frame} | step(state, V.to_array(r.data, r.height, r.width, r.channels)))
            yield pd.DataFrame(rows, columns=columns)

    return frames.repartition("video").sortWithinPartitions("video", "frame").mapInPandas(run, schema)


TRACKED = (
    "video string, frame int, accepted boolean, reason string, point_count int, mature_point_count int, valid_count int, mature_valid_count int, inlier_count int, "
    "inlier_ratio double, reprojection_error double, coverage_x double, coverage_y double, rejected_updates int, area double, center_x double, center_y double, "
    "top_edge double, right_edge double, bottom_edge double, left_edge double, " + ", ".join(f"{c}_{a} double" for c in ("tl", "tr", "br", "bl") for a in "xy")
)


def reference_tracks(frames: DataFrame, config: Config | None = None) -> DataFrame:
    """Tracker rows of frames(video, frame, height, width, channels, data,
    corners): corners (eight doubles) of a video's first frame are its quad."""
    config = config or Config()
    return _streamed(frames, TRACKED, lambda r: ReferenceTracker(config, np.array(r.corners, float).reshape(4, 2)), lambda t, image: t.step(V.gray(image)))


def flow_tracks(frames: DataFrame, config: Config | None = None) -> DataFrame:
    """(video, frame, predicted, detected, inlier_count, corners)."""
    config = config or Config()
    schema = "video string, frame int, predicted boolean, detected boolean, inlier_count int, corners array<double>"
    return _streamed(frames, schema, lambda r: FlowTracker(config), lambda t, image: t.step(image))


def horizontal_edges(image: np.ndarray, low: float = 30.0) -> np.ndarray:
    """Strong vertical gradients, closed along the row."""
    dy = np.abs(np.gradient(image)[0])
    mask = dy >= low
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(mask, ((0, 0), (4, 4))), 9, axis=1).any(-1)
    return np.lib.stride_tricks.sliding_window_view(np.pad(wide, ((0, 0), (4, 4)), constant_values=True), 9, axis=1).all(-1) & (dy >= low / 2)


Line = tuple[float, float, tuple[float, float], tuple[float, float]]


def hough_segments(mask: np.ndarray, most_angle: float = 3.0, step: float = 0.1, votes: int = 110, gap: int = 18, least: float | None = None) -> list[Line]:
    """(angle, length, ends) of near-level runs of edge points: for each angle the
    points vote for their offset; on the offsets with enough votes, runs without
    a longer gap that are long enough count once, for their best angle."""
    least = max(140, mask.shape[1] // 10) if least is None else least
    y, x = np.nonzero(mask)
    found = []
    for angle in np.arange(-most_angle, most_angle + step / 2, step):
        t = np.radians(angle)
        rho = np.rint(y * np.cos(t) - x * np.sin(t)).astype(int)
        base = rho.min(initial=0)
        count = np.bincount(rho - base)
        for r in np.flatnonzero(count >= votes):
            along = np.sort(x[rho - base == r])
            cuts = np.flatnonzero(np.diff(along) > gap) + 1
            for part in np.split(along, cuts):
                length = (part[-1] - part[0]) / max(np.cos(t), 1e-9)
                if length >= least and len(part) >= votes:
                    found.append((len(part), float(angle), float(length), int(r + base), int(part[0]), int(part[-1])))
    out, taken = [], []
    for _, angle, length, r, a, b in sorted(found, reverse=True):
        if all(abs(r - q) > 60 or b < c or a > d for q, c, d in taken):
            taken.append((r, a, b))
            t = np.radians(angle)
            at = lambda x, r=r, t=t: (float(x), float((r + x * np.sin(t)) / np.cos(t)))
            out.append((angle, length, at(a), at(b)))
    return out


def hough_lines(mask: np.ndarray, most_angle: float = 3.0, **options) -> list[tuple[float, float]]:
    return [x[:2] for x in hough_segments(mask, most_angle, **options)]


def _bar(p: np.ndarray) -> tuple[float, float, float, tuple, tuple]:
    """(angle, long side, short side, ends of the middle line) of a component's
    box along its principal axis."""
    axes = np.linalg.eigh(np.cov((p - p.mean(0)).T))[1]
    major = axes[:, 1] * (1 if axes[0, 1] >= 0 else -1)
    minor = np.array([-major[1], major[0]])
    along, across = p @ major, p @ minor
    middle = minor * (across.min() + across.max()) / 2
    ends = (tuple((major * v + middle).tolist()) for v in (along.min(), along.max()))
    return float(np.degrees(np.arctan2(major[1], major[0]))), float(np.ptp(along) + 1), float(np.ptp(across) + 1), *ends


def components(mask: np.ndarray) -> list[np.ndarray]:
    """Points (x, y) of each 4-connected component, greatest first."""
    out, rest = [], mask.copy()
    while rest.any():
        part = V.largest_component(rest)
        if part.sum() < 0.002 * mask.size:
            break
        y, x = np.nonzero(part)
        out.append(np.column_stack((x, y)).astype(float))
        rest &= ~part
    return out


def component_segments(mask: np.ndarray, select: np.ndarray, most_angle: float = 3.0, least_long: float | None = None, least_short: float = 3.0) -> list[Line]:
    """(angle, weighted length, ends) of components that look like bars: length
    counts by how far they fill their box."""
    h, w = mask.shape
    least_long = max(180, w // 8) if least_long is None else least_long
    out = []
    for p in components(mask):
        x0, y0, x1, y1 = p[:, 0].min(), p[:, 1].min(), p[:, 0].max(), p[:, 1].max()
        touches = x0 <= 1 or y0 <= 1 or x1 >= w - 2 or y1 >= h - 2
        framing = touches and (x1 - x0 + 1 > 0.9 * w or y1 - y0 + 1 > 0.9 * h)
        if not select[int(y0) : int(y1) + 1, int(x0) : int(x1) + 1].any() or framing:
            continue
        angle, long, short, a, b = _bar(p)
        fill = len(p) / max(long * short, 1)
        if long >= least_long and short >= least_short and fill >= 0.35 and long / max(short, 1) >= 1.2 and abs(angle) <= most_angle:
            out.append((angle, float(long * min(fill, 1)), a, b))
    return out


def component_lines(mask: np.ndarray, select: np.ndarray, most_angle: float = 3.0, **options) -> list[tuple[float, float]]:
    return [x[:2] for x in component_segments(mask, select, most_angle, **options)]


def contour_segments(image: np.ndarray, mask: np.ndarray, most_angle: float = 3.0, kernel: int = 25, thickness: float = 12.0, least: float | None = None) -> list[Line]:
    """(angle, length, ends) of thin long components of the edges that are left
    when runs along the row shorter than the kernel go."""
    least = max(180, mask.shape[1] // 8) if least is None else least
    edges = horizontal_edges(image) & mask
    pad = kernel // 2
    runs = np.lib.stride_tricks.sliding_window_view(np.pad(edges, ((0, 0), (pad, pad))), kernel, axis=1).all(-1)
    opened = np.lib.stride_tricks.sliding_window_view(np.pad(runs, ((0, 0), (pad, pad))), kernel, axis=1).any(-1)
    out = []
    for p in components(V.dilate(opened, 3)):
        angle, long, short, a, b = _bar(p)
        if long >= least and short <= thickness and abs(angle) <= most_angle:
            out.append((angle, long, a, b))
    return out


def contour_lines(image: np.ndarray, mask: np.ndarray, most_angle: float = 3.0, **options) -> list[tuple[float, float]]:
    return [x[:2] for x in contour_segments(image, mask, most_angle, **options)]


_POINT = "struct<x:double,y:double>"


def line_segments(frames: DataFrame, detector: str = "hough", most_angle: float = 3.0) -> DataFrame:
    """(video, frame, angle, length, p1, p2) a row per line candidate of frames
    (video, frame, height, width, channels, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                image = V.to_array(r.data, r.height, r.width, r.channels)
                select = V.line_roll_mask(r.height, r.width)
                if detector == "hough":
                    found = hough_segments(horizontal_edges(V.gray(image)) & select, most_angle)
                elif detector == "contour":
                    found = contour_segments(V.gray(image), select, most_angle)
                else:
                    found = component_segments(V.foreground(image, np.ones_like(select)), select, most_angle)
                if found:
                    point = lambda p: {"x": p[0], "y": p[1]}
                    yield pd.DataFrame([(r.video, r.frame, a, n, point(p), point(q)) for a, n, p, q in found], columns=["video", "frame", "angle", "length", "p1", "p2"])

    return frames.mapInPandas(run, f"video string, frame int, angle double, length double, p1 {_POINT}, p2 {_POINT}")


def line_candidates(frames: DataFrame, detector: str = "hough", most_angle: float = 3.0) -> DataFrame:
    """(video, frame, angle, length) a row per line candidate, for
    dominant_direction()."""
    return line_segments(frames, detector, most_angle).drop("p1", "p2")


def roll_angles(frames: DataFrame, detector: str = "hough", cluster: float = 0.35, least_segments: int = 2, least_length: float = 1000.0, most_angle: float = 3.0) -> DataFrame:
    """The line-roll table: each frame's candidates, their consensus and whether
    it is enough. Fewer candidates than segments are told as they are, with all
    their length; a frame without any has none."""
    found = line_candidates(frames, detector, most_angle)
    agreed = dominant_direction(found, ["video", "frame"], "angle", "length", cluster, least_segments, least_length)
    total = found.groupBy("video", "frame").agg(F.sum("length").alias("all_length"))
    rows = frames.select("video", "frame").join(agreed, ["video", "frame"], "left").join(total, ["video", "frame"], "left")
    raw = F.coalesce("candidates", F.lit(0))
    few = raw < least_segments
    return rows.select(
        "video", "frame", raw.cast("int").alias("raw_candidates"), F.when(few, raw).otherwise(F.col("inliers")).cast("int").alias("same_direction_inliers"),
        F.when(~few, F.col("dominant_angle")).alias("dominant_angle_deg"), F.col("accepted_angle").alias("accepted_angle_deg"),
        F.coalesce(F.when(few, F.col("all_length")).otherwise(F.col("inlier_length")), F.lit(0.0)).alias("total_inlier_length_px"), F.coalesce("accepted", F.lit(False)).alias("accepted"),
    )
