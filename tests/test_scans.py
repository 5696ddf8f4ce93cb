"""Scans over blocks against folds in order, and voting against counting."""

import math
import random

from pyspark.sql import functions as F

from cadenza.operators import folds as D
from cadenza.operators import hough as L
from cadenza.operators import scans as S


def rows(n, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), rng.gauss(0, 9), rng.gauss(0, 9), rng.gauss(5, 1)])
    return [("long", k, value()) for k in range(n)] + [("gone", k, None) for k in range(5)] + [(None, k, value()) for k in range(40)] + [("one", 0, 2.0)]


def test_one_key_over_many_blocks(spark):
    given = rows(3000, 1)
    df = spark.createDataFrame(given, "g string, k long, v double").repartition(5)
    for blocks in (1, 7):
        out = S.ema_scan(df, "g", ["k"], "v", 0.9, "ema", blocks)
        assert out.columns == ["g", "k", "v", "ema"]
        got = {(r.g, r.k): r.ema for r in out.collect()}
        assert len(got) == len(given)
        for g in {r[0] for r in given}:
            step, state = D.Ema(0.9), None
            for _, k, v in sorted((r for r in given if r[0] == g), key=lambda r: r[1]):
                state, want = step(state, (v,))
                assert (got[g, k] is None) == (want is None) and (want is None or math.isclose(got[g, k], want, rel_tol=1e-9, abs_tol=1e-9))


def test_running_sums_and_holds(spark):
    given = rows(2000, 2)
    df = spark.createDataFrame(given, "g string, k long, v double")
    good = F.when(~F.isnan("v"), F.col("v"))
    got = {(r.g, r.k): (r.n, r.held) for r in S.running(df, "g", ["k"], {"n": good.isNotNull().cast("long")}, {"held": good}, 6).collect()}
    for g in {r[0] for r in given}:
        n, held = 0, None
        for _, k, v in sorted((r for r in given if r[0] == g), key=lambda r: r[1]):
            if v is not None and v == v:
                n, held = n + 1, v
            assert got[g, k] == (n, held)
    empty = spark.createDataFrame([], "g string, k long, v double")
    assert S.running(empty, "g", ["k"], {"n": F.lit(1)}).count() == 0 and S.ema_scan(empty, "g", ["k"], "v", 0.5, "e").count() == 0


def test_planted_lines_are_found(spark):
    rng = random.Random(3)
    lines = [((10, 20), (190, 20)), ((20, 90), (180, 106)), ((30, 150), (90, 150)), ((105, 150), (190, 150))]
    pixels = {(rng.randrange(200), rng.randrange(200)) for _ in range(300)}
    for (x0, y0), (x1, y1) in lines:
        pixels |= {(x, round(y0 + (y1 - y0) * (x - x0) / (x1 - x0))) for x in range(x0, x1 + 1)}
    df = spark.createDataFrame([(1, x, y) for x, y in pixels for _ in range(1 + x % 2)], "f long, x long, y long")
    found = L.line_segments(df, ["f"], [a / 2 for a in range(-30, 31)], 50, 40.0, 8.0).collect()
    for (x0, y0), (x1, y1) in lines:
        near = [r for r in found if abs(r.y0 - y0) <= 3 and abs(r.y1 - y1) <= 3 and abs(r.x0 - x0) <= 9 and abs(r.x1 - x1) <= 9]
        assert near, (x0, y0)
        angle = math.degrees(math.atan2(y1 - y0, x1 - x0))
        assert any(abs(r.angle - angle) < 1 and r.length >= 40 for r in near)
    assert not [r for r in found if r.length < 40]


def test_peaks_count_once(spark):
    votes = [(1, 0, 0, 9), (1, 0, 1, 9), (1, 1, 1, 9), (1, 5, 5, 20), (1, 6, 6, 19), (1, 7, 7, 20), (2, 0, 0, 4)]
    got = L.peaks(spark.createDataFrame(votes, "f long, direction int, offset long, n long"), ["f"], 5).collect()
    assert sorted((r.direction, r.offset, r.votes) for r in got) == [(0, 0, 9), (5, 5, 20), (7, 7, 20)]
