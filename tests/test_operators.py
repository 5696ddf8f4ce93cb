"""Edge cases of the core operators against short definitions in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import geometry as G
from cadenza.functions import text as X
from cadenza.operators import aggregates as A
from cadenza.operators import folds as D
from cadenza.operators import gates as Q
from cadenza.operators import joins as J
from cadenza.operators import sampling as S
from cadenza.operators import vision as V
from cadenza.operators.timeseries import Series, centred_filter
from cadenza.plans.config import Config
from cadenza.plans.trajectory import refine
from cadenza.sources import schemas, tables


def series(spark, parts):
    rows = [(v, i, float(x), ok) for v, values in parts.items() for i, (x, ok) in enumerate(values)]
    return spark.createDataFrame(rows, "video string, frame long, value double, ok boolean").repartition(3)


def padded(values, width, f):
    if width <= 1 or len(values) < 3:
        return list(values)
    r = width // 2
    wide = np.pad(values, r, mode="edge")
    return [float(f(wide[i : i + 2 * r + 1])) for i in range(len(values))]


@pytest.mark.parametrize("width", [1, 3, 5, 31])
@pytest.mark.parametrize("kind", ["mean", "median"])
def test_centred_filter(spark, width, kind):
    rng = random.Random(width)
    parts = {f"v{n}": [(rng.uniform(-9, 9), True) for _ in range(n)] for n in (1, 2, 3, 4, 40)}
    out = centred_filter(series(spark, parts), Series("video", "frame"), ["value"], width, kind).collect()
    f = np.mean if kind == "mean" else np.median
    for v, values in parts.items():
        got = [r["value"] for r in sorted((r for r in out if r["video"] == v), key=lambda r: r["frame"])]
        assert np.allclose(got, padded([x for x, _ in values], width, f))


def test_interpolation(spark):
    marks = {"all": "1111", "none": "0000", "ends": "0110", "gap": "1001", "one": "0010", "single": "0"}
    parts = {k: [(float(i * i + 1), c == "1") for i, c in enumerate(m)] for k, m in marks.items()}
    s = Series("video", "frame")
    out = series(spark, parts).withColumn("out", s.interpolate(F.col("value"), F.col("ok"), F.col("frame"))).collect()
    for k, values in parts.items():
        at = [i for i, (_, ok) in enumerate(values) if ok]
        want = np.interp(range(len(values)), at, [values[i][0] for i in at]) if at else [x for x, _ in values]
        assert np.allclose([r["out"] for r in sorted((r for r in out if r["video"] == k), key=lambda r: r["frame"])], want)


def test_fold_keeps_last_accepted(spark):
    drift = {"a": [(10 * 1.05**k, True) for k in range(5)] + [(30, True), (12.5, True)], "b": [(1, False), (5, True), (5.1, True)]}
    out = D.fold(series(spark, drift), "video", ["frame"], ["value", "ok"], D.RatioGate(0.1), "kept", "boolean").orderBy("video", "frame").collect()
    assert [r["kept"] for r in out] == [True] * 5 + [False, True] + [False, True, True]


def test_geometry_gate_first_row_is_true_but_not_compared():
    gate, square = D.GeometryGate(), (0, 0, 10, 0, 10, 10, 0, 10)
    big = tuple(3 * v for v in square)
    state, out = None, []
    for row in [(False, *square), (True, *big), (True, *square), (True, *big)]:
        state, ok = gate(state, row)
        out.append(ok)
    assert out == [True, True, False, True]


def test_geometry_gate_orders_corners_and_skips_absent_ones():
    gate, square, nan = D.GeometryGate(), (0, 0, 10, 0, 10, 10, 0, 10), float("nan")
    turned = [square[2 * k :] + square[: 2 * k] for k in range(4)]
    state, out = None, []
    for quad in [*turned, (None, *square[1:]), (nan, *square[1:]), square]:
        state, ok = gate(state, (True, *quad))
        out.append(ok)
    assert out == [True] * 4 + [False, False, True]
    ratio, state, out = D.RatioGate(0.1), None, []
    for value in (None, nan, 5.0, None, nan, 5.2):
        state, ok = ratio(state, (value, True))
        out.append(ok)
    assert out == [False, False, True, False, False, True]


def test_line_roll_and_smoother():
    roll, state, out = D.LineRoll(limit=1.0, weight=0.5, most=0.1, jump=0.4), None, []
    for v in (5.0, None, 0.9, 0.2, float("nan")):
        state, o = roll(state, (v,))
        out.append(o)
    assert out[:2] == [1.0, 1.0] and math.isclose(out[2], 0.95) and out[3] == out[2] == out[4]
    smooth = D.ResidualSmoother(weight=0.5, translation_step=1.0)
    state, first = smooth(None, (0.5, -4.0, 4.0, 2.0))
    assert first == [0.25, -1.0, 2.0, 1.5]
    state, none = smooth(smooth(None, (None, 0.0, 0.0, 1.0))[0], (None, 0.0, 0.0, 1.0))
    state, second = smooth(state, (10.0, 1.0, 2.0, 1.5))
    assert none is None and second == [1.0, 0.5, 1.0, 1.25]


def corner_order(p):
    s, d = [x + y for x, y in p], [y - x for x, y in p]
    return [p[s.index(min(s))], p[d.index(min(d))], p[s.index(max(s))], p[d.index(max(d))]]


def test_order_corners_ties_and_permutations(spark):
    rng = random.Random(5)
    quads = [[(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(4)] for _ in range(200)]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in q]) for i, q in enumerate(quads)], "i int, q array<struct<x:double,y:double>>")
    for r in df.withColumn("o", G.order_corners(F.col("q"))).collect():
        assert [(p["x"], p["y"]) for p in r["o"]] == [tuple(map(float, p)) for p in corner_order(quads[r["i"]])]


def test_homography_round_trip(spark):
    q = spark.createDataFrame([("124,116:1488,132:1516,850:145,934",)], "t string").withColumn("q", X.parse_corners(F.col("t")))
    q = q.withColumn("h", G.homography(F.col("q"), G.canvas(1920, 1080)))
    q = q.withColumns({"p": G.project(F.col("q"), F.col("h")), "b": G.project(G.project(F.col("q"), F.col("h")), G.invert(F.col("h")))})
    r = q.collect()[0]
    assert np.allclose([(p["x"], p["y"]) for p in r["p"]], [(0, 0), (1919, 0), (1919, 1079), (0, 1079)], atol=1e-6)
    assert np.allclose([(p["x"], p["y"]) for p in r["b"]], [(124, 116), (1488, 132), (1516, 850), (145, 934)], atol=1e-6)


def test_components_of_nothing_are_nan(spark):
    r = spark.range(1).select(G.components(F.lit(None).cast("array<double>")).alias("c")).first()["c"]
    assert len(r) == 8 and all(math.isnan(v) for v in r)


def test_angles_and_rounding(spark):
    angles = [-90.0, 90.0, -91.0, 271.0, 0.5]
    df = spark.createDataFrame([(a,) for a in angles], "a double")
    assert [r[0] for r in df.select(G.normalize_line_angle(F.col("a"))).collect()] == [90, 90, 89, -89, 0.5]
    r = spark.range(1).select(G.nearest_frame(F.lit(2.5), F.lit(1.0), F.lit(10)), G.nearest_frame(F.lit(99.0), F.lit(1.0), F.lit(10))).first()
    assert tuple(r) == (2, 9)


@pytest.mark.parametrize(("text", "good"), [("1,2:3,4:5,6:7,8", True), ("1,2:3,4", False), ("1,2:3,x:5,6:7,8", False), ("", False), ("1,2:3,4:5,6:7,8,9", False)])
def test_parse_corners(spark, text, good):
    r = spark.createDataFrame([(text,)], "t string").select(X.parse_corners(F.col("t")).alias("c"), X.format_points(X.parse_corners(F.col("t"))).alias("f")).first()
    assert (r["c"] is not None) is good
    if good:
        assert r["f"] == text


def test_text_forms(spark):
    df = spark.createDataFrame([("..a b/ü-",), ("///",), ("",), ("1, ,2",), ("1,-2",)], "t string")
    rows = df.select(X.clean_path_part(F.col("t")), X.parse_frames(F.col("t"))).collect()
    assert [r[0] for r in rows[:3]] == ["a_b_ü", "run", "run"] and rows[3][1] == [1, 2] and rows[4][1] is None


def test_cascades(spark):
    row = spark.createDataFrame([(30, 39, 0.1, 9.0, 0.0, 0.0), (30, 40, 0.25, 2.5, 0.25, 0.2), (19, 0, 0.0, float("inf"), 0.0, 0.0)], "m int, i int, r double, e double, x double, y double")
    reason = Q.TrackerGates().reason(mature="m", inliers="i", ratio="r", error="e", cov_x="x", cov_y="y")
    assert [r[0] for r in row.select(reason).collect()] == ["not_enough_inliers", "accepted", "not_enough_mature_points"]
    zero = Q.TrackerGates(reprojection_error=0.0).reason(mature="m", inliers="i", ratio="r", error="e", cov_x="x", cov_y="y")
    assert row.select(zero).collect()[1][0] == "high_reprojection_error"
    finite = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in finite.select(Q.finite(F.col("v"))).collect()] == [True, False, False, False]


def test_last_seconds_of_the_published_clip(spark):
    times = spark.range(1, 317).select((F.col("id") / 60.1465).alias("t"))
    assert times.filter(Q.in_last_seconds(F.col("t"), F.lit(317 / 60.1465), 2.0)).count() == 120


def test_published_improvement(spark):
    rows = [("clip", "detect", 1.9267), ("clip", "flow", 1.9292), ("clip", "reference", 0.1179)]
    df = spark.createDataFrame(rows, "scenario string, method string, p95 double")
    r = A.improvement_ratio(df, ["scenario"], "method", "p95", "detect", "reference").first()
    assert round(r["improvement"], 1) == 16.3
    wide = A.method_pivot(df, ["scenario"], "method", "p95", ["detect", "flow", "reference"]).first()
    assert tuple(wide) == ("clip", 1.9267, 1.9292, 0.1179)


def test_summary_of_nothing_is_null(spark):
    df = series(spark, {"v": [(1.0, False)]})
    r = A.summarize(df, "video", {"m": F.col("value")}, F.col("ok")).first()
    assert (r["pairs"], r["ok_pairs"], r["m_mean"], r["m_p95"], r["m_max"]) == (1, 0, None, None, None)


def test_weighted_median_at_exactly_half(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 1.0), ("k", 3.0, 1.0), ("z", 5.0, 1.0)], "k string, v double, w double")
    assert {r["k"]: r["weighted_median"] for r in A.weighted_median(df, ["k"], "v", "w").collect()} == {"k": 1.0, "z": 5.0}


def test_spine(spark):
    videos = spark.createDataFrame([("v", 4), ("e", 0)], "video string, frame_count int")
    rows = spark.createDataFrame([("v", 0, False, 1), ("v", 1, True, 2), ("v", 1, False, 3), ("v", 9, False, 4), ("v", None, False, 5)], "video string, frame long, accepted boolean, seq int")
    out = J.reliability_spine(videos, rows).orderBy("frame").collect()
    assert [r["reliable"] for r in out] == [True, False, True, True]


def test_strict_zip_raises_on_a_missing_partner(spark):
    a = spark.createDataFrame([(0, 1), (1, 2)], "frame int, a int")
    assert J.strict_zip(a, a.withColumnRenamed("a", "b"), ["frame"]).count() == 2
    with pytest.raises(Exception, match="unlike length"):
        J.strict_zip(a, a.filter("frame = 0").withColumnRenamed("a", "b"), ["frame"]).collect()


def test_without_near(spark):
    rng = random.Random(1)
    pts = lambda n: [("v", i, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(n)]
    new, known = pts(80), pts(40)
    schema = "video string, id int, x double, y double"
    out = J.without_near(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema), ["video"], 8.0)
    want = {i for _, i, x, y in new if all((x - a) ** 2 + (y - b) ** 2 >= 64 for _, _, a, b in known)}
    assert {r["id"] for r in out.collect()} == want


def test_even_frames(spark):
    v = spark.createDataFrame([("v", 184), ("w", 1)], "video string, frame_count int")
    got = [r["frame"] for r in S.even_frames(v, 8).filter("video = 'v'").orderBy("sample").collect()]
    assert got == [round(x) for x in np.linspace(0, 183, 8)]
    assert [r["frame"] for r in S.even_frames(v, 1).collect()] == [0, 0]


def test_config():
    assert Config(median_window=9).with_profile("low-latency").median_window == 1
    for bad in ({"mean_window": 4}, {"smooth": 1.0}, {"crop_left": 0.4}, {"width": 0}, {"tracker": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_csv_round_trip(spark, tmp_path):
    text = "frame,accepted,reason,motion,translation_x,extra\n0,True,ok,homography,nan,9\n1,False,,affine,-inf,9\n2,True,ok,affine,1.5,9\n"
    (tmp_path / "a.csv").write_text(text)
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), schemas.ALIGN)
    assert df.columns == schemas.ALIGN.names
    rows = df.orderBy("frame").collect()
    assert math.isnan(rows[0]["translation_x"]) and rows[1]["translation_x"] == -math.inf and rows[1]["reason"] is None and rows[2]["accepted"] is True
    tables.write_csv(df.withColumn("more", F.lit(1)), str(tmp_path / "out"), schemas.ALIGN)
    again = tables.read_csv(spark, str(tmp_path / "out"), schemas.ALIGN).orderBy("frame").collect()
    assert [r["translation_x"] for r in again][1:] == [-math.inf, 1.5] and math.isnan(again[0]["translation_x"])


def test_annotations_round_trip(spark, tmp_path):
    rows = [("v", 1920, 1080, k, k / 30, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]) for k in range(3)]
    df = spark.createDataFrame(rows, "video string, width int, height int, frame int, time_seconds double, corners array<array<double>>")
    (tmp_path / "a.json").write_text(tables.annotation_document(df).first()["json"])
    assert sorted(map(tuple, tables.read_annotations(spark, str(tmp_path / "a.json")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "b.json").write_text('{"video": "v", "frames": [{"frame": 0, "corners": [[0, 0]]}]}')
    with pytest.raises(Exception, match="four corners"):
        tables.read_annotations(spark, str(tmp_path / "b.json")).collect()


def test_run_directory(spark, tmp_path):
    names = [tables.run_directory(spark, str(tmp_path), "run").rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["run", "run_01", "run_02"]


def test_refine_trajectory(spark):
    square = [100.0, 100.0, 500.0, 100.0, 500.0, 400.0, 100.0, 400.0]
    rows = [("v", k, *[v * (2 if k == 3 else 1) for v in square]) for k in range(8)]
    raw = spark.createDataFrame(rows, "video string, frame long, " + ", ".join(f"{c} double" for c in schemas.CORNERS))
    videos = spark.createDataFrame([("v", 8)], "video string, frame_count int")
    tracker = spark.createDataFrame([("v", 5, False, 0)], "video string, frame long, accepted boolean, seq int")
    out = refine(raw, videos, tracker, Config(median_window=1, mean_window=3)).orderBy("frame").collect()
    assert [r["reliable"] for r in out] == [True, True, True, False, True, False, True, True]
    assert all(math.isclose(r["smoothed_tl_x"], 100.0) and math.isclose(r["interpolated_br_y"], 400.0) for r in out)


def texture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    return V._box(rng.uniform(0, 255, (h, w)), 5) / 25


def test_pair_motion_finds_a_known_shift():
    big = texture(200, 240)
    a, b = big[20:180, 20:220], big[17:177, 15:215]
    m = V.pair_motion(a, b)
    assert m["ok"] and abs(m["translation_x_px"] - 5) < 0.3 and abs(m["translation_y_px"] - 3) < 0.3 and abs(m["scale_delta"]) < 0.01
    assert V.pair_motion(np.zeros((50, 50)), np.zeros((50, 50)))["reason"] == "not_enough_features"


def test_ransac_ignores_outliers():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 100, (60, 2))
    q = V.apply(np.array([[0.9, -0.2, 5], [0.2, 0.9, -3], [0, 0, 1]]), p)
    q[::6] += 50
    m, inside = V.ransac(p, q, V.fit_similarity, 2, 1.0)
    assert inside.sum() == 50 and np.allclose(m[0], [0.9, -0.2, 5], atol=1e-6)
    h, _ = V.ransac(p, q, V.fit_homography, 4, 1.0)
    assert np.allclose(V.apply(h, p)[1::6], q[1::6], atol=1e-4)


def test_screen_detection_and_warp(spark):
    image = np.zeros((120, 160, 3), np.uint8)
    image[30:100, 20:140] = (200, 120, 20)
    quad = V.detect_screen(image)
    assert np.allclose(quad, [(20, 30), (139, 30), (139, 99), (20, 99)], atol=1)
    assert V.detect_screen(np.zeros((40, 40, 3), np.uint8)) is None
    h = V.fit_homography(quad, np.array([(0, 0), (79, 0), (79, 39), (0, 39)], float))
    assert (V.warp(image, h, 80, 40)[5:35, 5:75] == (200, 120, 20)).all()
    rows = [("v", k, 120, 160, 3, image.tobytes()) for k in range(2)]
    df = spark.createDataFrame(rows, schemas.FRAMES)
    assert all(r["corners"] is not None for r in V.screen_corners(df).collect())
    assert [r["reason"] for r in V.adjacent_motion(df).collect()] == ["not_enough_features"]


def test_tables_of_transforms_equal_the_column_forms(spark):
    from cadenza.functions import geometry as G

    rng = np.random.default_rng(2)
    rows = [(k, [(float(x), float(y)) for x, y in rng.uniform(0, 900, (4, 2))]) for k in range(50)] + [(50, [(1.0, 1.0)] * 4)]
    df = spark.createDataFrame(rows, "k int, quad array<struct<x:double,y:double>>")
    df = G.with_inverse(G.with_canvas_homography(df, "quad", 640, 480, "h"), "h", "v")
    assert df.columns == ["k", "quad", "h", "v"]
    both = df.select("h", "v", G.homography(F.col("quad"), G.canvas(640, 480)).alias("h2"), G.invert(F.col("h")).alias("v2")).collect()
    assert all(r["h"] == r["h2"] and r["v"] == r["v2"] for r in both) and both[50]["h"] == [None] * 9


def test_dominant_direction_is_one_pass(spark):
    from cadenza.operators import aggregates as A

    rows = [(k % 3 if k % 10 else None, float(k % 7) / 10, float(k % 5)) for k in range(200)]
    found = A.dominant_direction(spark.createDataFrame(rows, "g long, a double, w double"), ["g"], "a", "w", 0.15, 2, 1.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for r in found.collect():
        mine = [(a, w) for g, a, w in rows if g == r.g]
        middle = lambda of: min(a for a, _ in of if sum(w for b, w in of if b <= a) >= sum(w for _, w in of) / 2)
        near = [(a, w) for a, w in mine if abs(a - middle(mine)) <= 0.15]
        assert (r.dominant_angle, r.candidates, r.inliers, r.inlier_length, r.accepted_angle) == (middle(mine), len(mine), len(near), sum(w for _, w in near), middle(near))
    assert found.count() == 3
