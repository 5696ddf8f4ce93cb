"""Reduced outlines against recursion in Python."""

import math
import random

from pyspark.sql import functions as F

from cadenza.operators import outlines as O


def plain(points, share):
    """Kept indices, by recursion."""
    n = len(points)
    length = sum(math.dist(points[k], points[(k + 1) % n]) for k in range(n))
    a = max(range(n), key=lambda k: (math.dist(points[k], points[0]), -k))
    b = max(range(n), key=lambda k: (math.dist(points[k], points[a]), -k))
    kept = {a, b}

    def far(k, s, e):
        (ax, ay), (bx, by), (x, y) = points[s], points[e], points[k]
        d = math.hypot(bx - ax, by - ay)
        return abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / d if d else math.hypot(x - ax, y - ay)

    def split(s, e):
        inner = [(s + j) % n for j in range(1, (e - s) % n or n)]
        if not inner:
            return
        c = max(inner, key=lambda k: (far(k, s, e), -((k - a) % n)))
        if far(c, s, e) > share * length:
            kept.add(c)
            split(s, c)
            split(c, e)

    if a == b:
        split(a, a)
    else:
        split(a, b)
        split(b, a)
    return sorted(kept)


def test_rounds_equal_recursion(spark):
    rng = random.Random(9)
    shapes = [[(math.cos(k / n * 6.283) * 50 + rng.gauss(0, s), math.sin(k / n * 6.283) * 30 + rng.gauss(0, s)) for k in range(n)] for n in (5, 40, 200) for s in (0, 1, 5)]
    shapes += [[(k, 0) for k in range(9)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1)], [(2, 2)] * 5, [(0, 0), (5, 5)]]
    rows = [(g, i, float(x), float(y), "z") for g, s in enumerate(shapes) for i, (x, y) in enumerate(s)]
    df = spark.createDataFrame(rows, "g long, i long, x double, y double, n string").repartition(4)
    for r in O.simplified(df, ["g"], [0.001, 0.01, 0.05]).collect():
        want = plain([(float(x), float(y)) for x, y in shapes[r.g]], r.tolerance)
        assert [c.i for c in r.corners] == want, (r.g, r.tolerance)
    assert O.simplified(df.filter(F.lit(False)), ["g"]).count() == 0


def test_first_tolerance_with_a_screen(spark):
    rng = random.Random(3)
    corners = [(100, 80), (820, 100), (800, 520), (90, 500)]
    ring = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        ring += [(ax + (bx - ax) * k / 50 + rng.uniform(-2, 2), ay + (by - ay) * k / 50 + rng.uniform(-2, 2)) for k in range(50)]
    small = [(x / 9, y / 9) for x, y in ring]
    rows = [(g, i, x, y) for g, s in enumerate((ring, small)) for i, (x, y) in enumerate(s)]
    got = O.screen_outlines(spark.createDataFrame(rows, "g long, i long, x double, y double"), ["g"], 960.0, 600.0).collect()
    assert [r.g for r in got] == [0] and got[0].tolerance in O.TOLERANCES
    assert all(math.dist((p.x, p.y), c) < 8 for p, c in zip(got[0].quad, corners, strict=True))
