"""Regions, hulls and boxes against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import hulls as H
from cadenza.operators import labels as L
from cadenza.operators import regions as R
from cadenza.sources import scratch


def flood(cells, start, steps):
    seen, todo = {start}, [start]
    while todo:
        x, y = todo.pop()
        for dx, dy in steps:
            n = (x + dx, y + dy)
            if n in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]
ALL = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]


def plain_regions(lit, width, height):
    """Sets of pixels: what the margin's flood leaves, by touching pixels."""
    around = {(x, y) for x in range(-1, width + 1) for y in range(-1, height + 1)} - lit
    rest = {(x, y) for x in range(width) for y in range(height)} - flood(around, (-1, -1), SIDES)
    out = []
    while rest:
        one = flood(rest, next(iter(rest)), ALL)
        out.append(one)
        rest -= one
    return out


def plain_hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(points)[:-1] + half(points[::-1])[:-1]


def plain_box(hull):
    """Area of the least box, by trying every side."""
    best = math.inf
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        n = math.hypot(bx - ax, by - ay)
        if n:
            ux, uy = (bx - ax) / n, (by - ay) / n
            along, across = [x * ux + y * uy for x, y in hull], [y * ux - x * uy for x, y in hull]
            best = min(best, (max(along) - min(along)) * (max(across) - min(across)))
    return 0.0 if best == math.inf else best


def masks():
    rng = random.Random(7)
    ring = {(x, y) for x in range(10, 90) for y in range(3, 15) if x in (10, 89) or y in (3, 14)}
    nested = {(x, y) for x in range(30, 50) for y in range(6, 11)}
    diamond = {(100, 5), (99, 6), (101, 6), (100, 7)}
    touching = {(110, 5), (111, 6), (112, 5), (120, 5), (121, 5), (123, 5)}
    yield ring | nested | diamond | touching | {(140, 19), (0, 0)}, 141, 20
    yield set(), 5, 4
    yield {(x, y) for x in range(7) for y in range(6)}, 7, 6
    spiral, x, y, dx, dy = set(), 0, 0, 1, 0
    for size in (30, 18, 28, 16, 26, 14, 24, 12, 22, 10):
        for _ in range(size):
            spiral.add((x, y))
            x, y = x + dx, y + dy
        dx, dy = -dy, dx
    yield {p for p in spiral if 0 <= p[0] < 32 and 0 <= p[1] < 20}, 32, 20
    for density in (0.2, 0.4, 0.5, 0.65):
        for width, height in ((150, 12), (9, 30)):
            yield {(x, y) for x in range(width) for y in range(height) if rng.random() < density}, width, height


@pytest.fixture(scope="module")
def regions(spark):
    given = list(masks())
    pixels = spark.createDataFrame([(k, x, y) for k, (m, _, _) in enumerate(given) for x, y in m for _ in range(1 + (x + y) % 2)], "frame long, x long, y long")
    frames = spark.createDataFrame([(k, w, h) for k, (_, w, h) in enumerate(given)], "frame long, width int, height int")
    found = scratch.written(R.outer_regions(R.row_runs(pixels, ["frame"]), frames, ["frame"]), "regions")
    return given, pixels, frames, found


def test_outer_regions_are_those_of_flooding(regions):
    given, _, _, found = regions
    got = {}
    for r in found.collect():
        got.setdefault((r.frame, r.label), set()).update((x, r.y) for x in range(r.x0, r.x1 + 1))
    for k, (lit, width, height) in enumerate(given):
        want = {frozenset(p) for p in plain_regions(lit, width, height)}
        assert {frozenset(p) for (f, _), p in got.items() if f == k} == want
    assert all(label == min((y + 1) * 2**32 + x + 1 for x, y in p) for (_, label), p in got.items())


def test_areas_count_windows(regions):
    given, _, _, found = regions
    got = {(r.frame, r.label): r.area for r in R.region_areas(found, ["frame"]).collect()}
    for k, (lit, width, height) in enumerate(given):
        for p in plain_regions(lit, width, height):
            corners = {(x - dx, y - dy) for x, y in p for dx in (0, 1) for dy in (0, 1)}
            four = [sum((x + dx, y + dy) in p for dx in (0, 1) for dy in (0, 1)) for x, y in corners]
            assert got[k, min((y + 1) * 2**32 + x + 1 for x, y in p)] == four.count(4) + four.count(3) / 2
    assert sum(len(plain_regions(*m)) for m in given) == len(got)


def test_candidates_have_their_least_box(regions):
    given, pixels, frames, _ = regions
    band = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 150), ("y1", 30))])
    got = {(r.frame, r.label): r for r in R.component_candidates(pixels, frames, ["frame"], band).collect()}
    for k, (lit, width, height) in enumerate(given):
        for p in plain_regions(lit, width, height):
            r = got[k, min((y + 1) * 2**32 + x + 1 for x, y in p)]
            assert r.pixels == len(p) and (r.x0, r.x1) == (min(x for x, _ in p), max(x for x, _ in p) + 1)
            assert math.isclose(r.long * r.short, plain_box(plain_hull(p)), rel_tol=1e-9, abs_tol=1e-6)


def test_components_of_many_graphs(spark):
    rng = random.Random(3)
    edges = [(g, rng.randrange(60), rng.randrange(60)) for g in range(4) for _ in range(35)]
    edges += [(9, k, k + 1) for k in range(70)] + [(8, 5, k) for k in range(100)]
    got = {(r.g, r.node): r.root for r in L.components(spark.createDataFrame(edges, "g long, a long, b long"), ["g"]).collect()}
    near = {}
    for g, a, b in edges:
        near.setdefault((g, a), set()).add(b)
        near.setdefault((g, b), set()).add(a)
    for g, a in near:
        seen, todo = {a}, [a]
        while todo:
            for n in near[g, todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got.get((g, a), a) == min(seen)
    assert L.components(spark.createDataFrame([], "g long, a long, b long"), ["g"]).count() == 0


def test_hulls_of_chunks_are_the_hull(spark):
    rng = random.Random(2)
    sets = [[(rng.gauss(0, 9), rng.gauss(0, 3)) for _ in range(3000)], [(rng.randrange(9), rng.randrange(9)) for _ in range(400)], [(math.cos(k), math.sin(k)) for k in range(300)]]
    sets += [[(k, 2 * k) for k in range(20)], [(4, k) for k in range(9)], [(1, 1)], [(1, 1), (1, 1), (5, 2)]]
    rows = [(g, float(x), float(y)) for g, ps in enumerate(sets) for x, y in ps] + [(0, None, 1.0), (0, float("nan"), 2.0)]
    points = spark.createDataFrame(rows, "g long, x double, y double")
    for chunk in (64, 100_000):
        got = H.convex_hull(points, ["g"], chunk).withColumn("a", H.hull_area(F.col("hull"))).withColumn("box", H.least_box(F.col("hull"))).collect()
        assert len(got) == len(sets)
        for r in got:
            want = plain_hull([(float(x), float(y)) for x, y in sets[r.g]])
            assert {(p.x, p.y) for p in r.hull} == set(want) and len(r.hull) == len(want)
            assert math.isclose(r.box.width * r.box.height, plain_box(want), rel_tol=1e-9, abs_tol=1e-9)
            assert 0 <= r.box.angle < 90


def test_one_large_set_is_dealt_to_tasks(spark):
    points = spark.range(300_000).select(F.lit(1).alias("g"), F.randn(1).alias("x"), F.randn(2).alias("y"))
    row = H.convex_hull(points.repartition(4), ["g"]).select(F.size("hull").alias("n"), H.hull_area(F.col("hull")).alias("a")).first()
    assert 8 <= row.n < 60 and 50 < row.a < 110


def test_what_was_written_aside_can_be_removed(spark):
    kept = scratch.written(spark.range(3), "kept")
    assert kept.count() == 3
    scratch.purge(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.read.schema(kept.schema).parquet(kept._written_at).count()
