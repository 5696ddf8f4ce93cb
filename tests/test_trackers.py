"""Trackers and line detectors on synthetic frames with known motion."""

import numpy as np
import pytest

from cadenza.operators import aggregates as A
from cadenza.operators import trackers as R
from cadenza.operators import vision as V
from cadenza.plans.config import Config

QUAD = np.array([(40, 30), (200, 30), (200, 130), (40, 130)], float)


def frame(shift, seed=3):
    rng = np.random.default_rng(seed)
    big = V._box(rng.uniform(0, 255, (200, 280)), 3) / 9
    dx, dy = shift
    return np.repeat(V.sample(big, *(np.meshgrid(np.arange(240.0) + 20 - dx, np.arange(160.0) + 20 - dy)))[..., None], 3, axis=2).astype(np.uint8)


def test_reference_tracker_follows_a_drift():
    t = R.ReferenceTracker(Config(least_point_age=1), QUAD)
    rows = [t.step(V.gray(frame((0.8 * k, 0.4 * k)))) for k in range(5)]
    assert [r["reason"] for r in rows] == ["initial_reference"] + ["accepted"] * 4
    assert abs(rows[-1]["tl_x"] - 43.2) < 0.5 and abs(rows[-1]["br_y"] - 131.6) < 0.5
    assert rows[-1]["inlier_count"] >= 40 and rows[-1]["coverage_x"] > 0.5


def test_reference_tracker_holds_on_a_blank_frame():
    t = R.ReferenceTracker(Config(least_point_age=1), QUAD)
    t.step(V.gray(frame((0, 0))))
    row = t.step(np.zeros((160, 240)))
    assert not row["accepted"] and row["tl_x"] == 40 and row["rejected_updates"] in (0, 1)


def test_flow_tracker_detects_then_follows():
    image = np.zeros((160, 240, 3), np.uint8)
    image[30:131, 40:201] = (200, 120, 20)
    rng = np.random.default_rng(1)
    image[30:131, 40:201] += rng.integers(0, 40, (101, 161, 1)).astype(np.uint8)
    t = R.FlowTracker(Config())
    first, second = t.step(image), t.step(np.roll(image, 2, axis=1))
    assert first["detected"] and np.allclose(first["corners"].reshape(4, 2), QUAD, atol=1.5)
    assert np.allclose(second["corners"].reshape(4, 2)[:, 0].mean(), 122, atol=1.0)


@pytest.mark.parametrize("angle", [0.0, 1.0, -1.5])
def test_lines_have_their_angle(angle):
    y, x = np.mgrid[:240, :400]
    line = np.abs((y - 30 - np.tan(np.radians(angle)) * (x - 200))) < 4
    image = np.where(line, 0.0, 255.0)
    found = R.hough_lines(R.horizontal_edges(image))
    assert found and abs(np.average([a for a, _ in found], weights=[n for _, n in found]) - angle) < 0.35
    assert R.component_lines(line, np.ones_like(line)) == []  # as wide as the frame
    parts = R.component_lines(line & (np.abs(x - 200) < 170), np.ones_like(line))
    assert len(parts) == 1 and abs(parts[0][0] - angle) < 0.2


def test_frames_through_spark(spark):
    from cadenza.plans.catalogue import read  # noqa: F401

    spark.sparkContext.environment["PYTHONPATH"] = R.__file__.rsplit("/cadenza/", 1)[0]
    rows = [(v, k, 160, 240, 3, frame((0.5 * k, 0)).tobytes(), QUAD.reshape(-1).tolist()) for v in "ab" for k in range(3)]
    df = spark.createDataFrame(rows, "video string, frame int, height int, width int, channels int, data binary, corners array<double>")
    out = R.reference_tracks(df, Config(least_point_age=1)).orderBy("video", "frame").collect()
    assert [r["reason"] for r in out] == ["initial_reference", "accepted", "accepted"] * 2
    assert R.flow_tracks(df).count() == 6
    y, x = np.mgrid[:240, :400]
    image = np.repeat(np.where(np.abs(y - 30 - np.tan(np.radians(1.0)) * (x - 200)) < 4, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
    lines = R.line_candidates(spark.createDataFrame([("v", 0, 240, 400, 3, image.tobytes())], "video string, frame int, height int, width int, channels int, data binary"))
    got = A.dominant_direction(lines, ["video", "frame"], "angle", "length", 0.35, 1, 100.0).first()
    assert got["accepted"] and abs(got["accepted_angle"] - 1.0) < 0.35


def test_reference_tracker_under_perspective_and_scale():
    """Known transforms of the scene: corners come out ordered, in the frame."""
    rng = np.random.default_rng(5)
    scene = np.repeat((V._box(rng.uniform(0, 255, (160, 240)), 3) / 9)[..., None], 3, axis=2)
    t = R.ReferenceTracker(Config(least_point_age=1), QUAD)
    for k in range(4):
        h = np.array([[1 + 0.004 * k, 0.001 * k, 0.6 * k], [-0.001 * k, 1 + 0.004 * k, 0.3 * k], [1e-5 * k, 0, 1]])
        row = t.step(V.gray(V.warp(scene, h, 240, 160)))
        assert row["accepted"]
        want = V.apply(h, QUAD)
        got = np.array([(row[f"{c}_x"], row[f"{c}_y"]) for c in ("tl", "tr", "br", "bl")])
        assert np.abs(got - want).max() < 1.0


def test_screen_with_specks_and_without_form():
    image = np.zeros((160, 240, 3), np.uint8)
    image[30:131, 40:201] = (200, 120, 20)
    image[5:8, 5:8] = image[150:152, 230:233] = (200, 120, 20)
    image[60:64, 100:104] = 0
    assert np.allclose(V.detect_screen(image), QUAD, atol=1.5)
    tall = np.zeros((160, 240, 3), np.uint8)
    tall[5:155, 90:150] = (200, 120, 20)
    assert V.detect_screen(tall) is None and V.detect_screen(np.zeros((160, 240, 3), np.uint8)) is None


@pytest.mark.parametrize("motion", ["affine", "homography"])
def test_residual_alignment_measures_known_movement(motion):
    from cadenza.operators import alignment as L

    gates = L.AlignGates(inliers=20, rotation=2.0, scale_delta=0.05)
    a = L.Aligner(motion, gates)
    rows = [a.step(V.gray(frame((0.7 * k, -0.4 * k)))) for k in range(4)]
    assert [r["reason"] for r in rows] == ["reference_frame"] + ["accepted"] * 3
    assert abs(rows[3]["translation_x"] + 2.1) < 0.3 and abs(rows[3]["translation_y"] - 1.2) < 0.3
    blank = a.step(np.zeros((160, 240)))
    assert not blank["accepted"] and np.isnan(blank["translation_x"]) and np.allclose(blank["transform"], rows[3]["transform"])
    far = L.Aligner(motion, L.AlignGates(inliers=20, translation=1.0))
    far.step(V.gray(frame((0, 0))))
    assert far.step(V.gray(frame((3, 0))))["reason"] == "large_translation"
    assert L.align(np.zeros((160, 240)), np.zeros((160, 240)), None, motion, gates)[1]["reason"] == "not_enough_reference_points"


@pytest.mark.parametrize("detector", ["hough", "contour", "binary"])
def test_roll_angles_of_frames(spark, detector):
    from cadenza.operators import alignment as L

    spark.sparkContext.environment["PYTHONPATH"] = R.__file__.rsplit("/cadenza/", 1)[0]
    y, x = np.mgrid[:240, :400]
    rows = []
    for k, angle in enumerate((0.5, None)):
        lines = np.zeros((240, 400), bool)
        for top in (20, 215) if angle is not None else ():
            lines |= (np.abs(y - top - np.tan(np.radians(angle)) * (x - 200)) < 4) & (np.abs(x - 200) < 150)
        image = np.repeat(np.where(lines, 0, 255).astype(np.uint8)[..., None], 3, axis=2)
        rows.append(("v", k, 240, 400, 3, image.tobytes()))
    df = spark.createDataFrame(rows, "video string, frame int, height int, width int, channels int, data binary")
    out = R.roll_angles(df, detector, least_length=300.0).orderBy("frame").collect()
    assert out[0]["accepted"] and abs(out[0]["accepted_angle_deg"] - 0.5) < 0.35 and out[0]["same_direction_inliers"] >= 2
    for seg in R.line_segments(df, detector).collect():
        dx, dy = seg["p2"]["x"] - seg["p1"]["x"], seg["p2"]["y"] - seg["p1"]["y"]
        assert seg["frame"] == 0 and abs(np.degrees(np.arctan2(dy, dx)) - seg["angle"]) < 0.05 and abs(dx - 300) < 12
        assert min(abs(seg["p1"]["y"] + dy / 2 - top) for top in (20, 215)) < 6
    assert (out[1]["raw_candidates"], out[1]["total_inlier_length_px"], out[1]["accepted"]) == (0, 0.0, False)
    if detector == "hough":
        moved = [("v", k, 160, 240, 3, frame((0.5 * k, 0)).tobytes()) for k in range(3)]
        rows = L.residual_alignment(spark.createDataFrame(moved, df.schema), gates=L.AlignGates(inliers=20)).orderBy("frame").collect()
        assert [r["accepted"] for r in rows] == [True] * 3 and len(rows[2]["transform"]) == 9


def test_cubic_warp_and_crop():
    y, x = np.mgrid[:40, :60]
    ramp = np.repeat((2.0 * x + 1.5 * y + 20)[..., None], 3, axis=2)
    shifted = V.warp(ramp, np.array([[1, 0, 0.5], [0, 1, -0.25], [0, 0, 1]], float), 60, 40, cubic=True)
    want = np.rint(2.0 * (x - 0.5) + 1.5 * (y + 0.25) + 20)
    assert np.abs(shifted[3:-3, 3:-3, 0].astype(float) - want[3:-3, 3:-3]).max() <= 1
    cut = V.warp(ramp, V.crop_transform(60, 40, 0.1, 0.25, 0.1, 0.25), 60, 40)
    assert abs(float(cut[20, 30, 0]) - float(ramp[20, 30, 0])) <= 2 and abs(float(cut[0, 0, 0]) - float(ramp[10, 6, 0])) <= 2
    with pytest.raises(ValueError, match="empty"):
        V.crop_transform(60, 40, 0.5, 0, 0.5, 0)


def test_extra_arguments_split():
    from cadenza.plans.config import split_extra_args

    assert split_extra_args("--a 'b c' x- y- z w-") == ["--a", "b c", "x-y-", "z", "w-"]
