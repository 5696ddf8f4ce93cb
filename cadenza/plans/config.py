"""Parameters of the measurement pipeline, range-checked, with the presets."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_extra_args(text: str) -> list[str]:
    """Words of a command line, quotes as in a shell; a word that ends in a
    hyphen goes on in the next."""
    words, out = iter(shlex.split(text)), []
    for word in words:
        out.append(word + next(words, "") if word.endswith("-") else word)
    return out


def _odd(n: int) -> bool:
    return n > 0 and n % 2 == 1


# The defaults that make gates comparable.
@dataclass(frozen=True)
class Config:
    tracker: str = "flow"
    width: int = 1920
    height: int = 1080
    crf: int = 18
    smooth: float = 0.0
    detect_correction: float = 0.08
    feature_refresh: int = 15
    mean_window: int = 31
    median_window: int = 5
    least_inliers: int = 40
    least_inlier_ratio: float = 0.25
    most_reprojection_error: float = 2.5
    scale_step: float = 0.035
    area_step: float = 0.08
    least_point_age: int = 15
    least_coverage_x: float = 0.25
    least_coverage_y: float = 0.20
    align_filter_window: int = 1
    align_accept_ratio: float = 0.90
    interpolate: bool = True
    offline_gate: bool = True
    line_segments: int = 2
    line_length: float = 1000.0
    line_cluster: float = 0.35
    line_most_angle: float = 1.0
    line_most_step: float = 0.12
    line_most_jump: float = 0.45
    line_smooth: float = 0.80
    crop_left: float = 0.0
    crop_top: float = 0.0
    crop_right: float = 0.0
    crop_bottom: float = 0.0
    background_percentile: float = 50.0
    last_seconds: float = 2.0

    def __post_init__(self):
        checks = {
            "tracker": self.tracker in ("detect", "flow", "reference"),
            "width": self.width > 0,
            "height": self.height > 0,
            "crf": 0 <= self.crf <= 255,
            "smooth": 0 <= self.smooth < 1,
            "detect_correction": 0 <= self.detect_correction <= 1,
            "feature_refresh": self.feature_refresh > 0,
            "mean_window": _odd(self.mean_window),
            "median_window": _odd(self.median_window),
            "least_inlier_ratio": 0 <= self.least_inlier_ratio <= 1,
            "least_coverage_x": 0 <= self.least_coverage_x <= 1,
            "least_coverage_y": 0 <= self.least_coverage_y <= 1,
            "align_filter_window": _odd(self.align_filter_window),
            "align_accept_ratio": 0 <= self.align_accept_ratio <= 1,
            "line_smooth": 0 <= self.line_smooth < 1,
            "background_percentile": 0 <= self.background_percentile <= 100,
        } | {f.name: 0 <= getattr(self, f.name) < 0.4 for f in fields(self) if f.name.startswith("crop_")}
        checks |= {f.name: getattr(self, f.name) >= 0 for f in fields(self) if f.name not in checks and f.type in ("int", "float")}
        if bad := [k for k, ok in checks.items() if not ok]:
            raise ValueError(f"out of range: {', '.join(sorted(bad))}")

    def with_profile(self, name: str) -> Config:
        """A preset wins over what was set before."""
        return replace(self, **PROFILES[name])


PROFILES = {
    "dynamic": {"least_point_age": 15, "median_window": 5, "mean_window": 31},
    "low-latency": {"least_point_age": 1, "median_window": 1, "mean_window": 1},
}


def with_profiles(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """Settings as columns (point_age, median_window, mean_window), where a row's
    preset wins over what it asks; no preset leaves them."""
    out = {}
    for column, field in (("point_age", "least_point_age"), ("median_window", "median_window"), ("mean_window", "mean_window")):
        c = F.col(column)
        for name, values in PROFILES.items():
            c = F.when(F.col(profile) == name, values[field]).otherwise(c)
        out[column] = c
    return rows.withColumns(out)
