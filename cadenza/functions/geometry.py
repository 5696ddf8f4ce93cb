"""Planar geometry as Column expressions.

A point is a struct of doubles x and y, a quadrilateral an array of four points,
a transform an array of nine doubles in row order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
TL, TR, BR, BL = range(4)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _pick(points: Column, key) -> Column:
    ranked = F.array_min(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))
    return ranked["p"]


def order_corners(points: Column) -> Column:
    """TL, TR, BR, BL by least x+y, least y-x, greatest x+y, greatest y-x; of
    equals the first; a point may be picked twice."""
    return F.array(
        _pick(points, lambda p: p["x"] + p["y"]),
        _pick(points, lambda p: p["y"] - p["x"]),
        _pick(points, lambda p: -(p["x"] + p["y"])),
        _pick(points, lambda p: -(p["y"] - p["x"])),
    )


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def edges(quad: Column) -> dict[str, Column]:
    tl, tr, br, bl = (quad[i] for i in range(4))
    return {"top": distance(tr, tl), "right": distance(br, tr), "bottom": distance(br, bl), "left": distance(bl, tl)}


def area(quad: Column) -> Column:
    p = [quad[i] for i in range(4)]
    terms = [p[i]["x"] * p[(i + 1) % 4]["y"] - p[(i + 1) % 4]["x"] * p[i]["y"] for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def centroid(quad: Column) -> Column:
    p = [quad[i] for i in range(4)]
    return point((p[0]["x"] + p[1]["x"] + p[2]["x"] + p[3]["x"]) / 4, (p[0]["y"] + p[1]["y"] + p[2]["y"] + p[3]["y"]) / 4)


def quad_is_valid(quad: Column, width, height, least: float = 0.20, most: float = 0.85, narrow: float = 1.25, wide: float = 2.35) -> Column:
    """Area share of the frame and mean width over mean height within bounds."""
    e = edges(quad)
    share = area(quad) / (F.lit(width) * F.lit(height))
    w, h = (e["top"] + e["bottom"]) / 2, (e["left"] + e["right"]) / 2
    return share.between(least, most) & F.when(h <= 0, False).otherwise((w / h).between(narrow, wide))


def within_ratio(value: Column, previous: Column, step: float) -> Column:
    if step <= 0:
        return F.lit(True)
    return F.when(previous <= 0, False).otherwise((value / previous).between(1 - step, 1 + step))


def geometry_step_ok(now: Column, before: Column, scale_step: float, area_step: float) -> Column:
    """All edges positive on both sides, each within its step, then the area."""
    a, b = edges(now), edges(before)
    ok = F.lit(True)
    for k in a:
        ok = ok & (a[k] > 0) & (b[k] > 0)
    for k in a:
        ok = ok & within_ratio(a[k], b[k], scale_step)
    return ok & within_ratio(area(now), area(before), area_step)


def let(values: list[Column], f) -> Column:
    """f of values that are each evaluated once: a lambda's variable holds them,
    so long formulas stay as long as they are written."""
    held = F.array(F.array(*[v.cast("double") for v in values]))
    return F.transform(held, lambda v: f(*[v[i] for i in range(len(values))]))[0]


def _square_to_quad(quad: Column) -> Column:
    """Unit square to quad, the last entry one."""

    def outer(x0, y0, x1, y1, x2, y2, x3, y3):
        dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
        dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
        den = dx1 * dy2 - dx2 * dy1
        g, h = F.try_divide(sx * dy2 - dx2 * sy, den), F.try_divide(dx1 * sy - sx * dy1, den)
        return let([x0, y0, x1, y1, x3, y3, g, h], inner)

    def inner(x0, y0, x1, y1, x3, y3, g, h):
        return F.array(x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0))

    return let([quad[i][a] for i in range(4) for a in ("x", "y")], outer)


def _entries(m: Column) -> list[Column]:
    return [m[i] for i in range(9)]


def _adjugate(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def _times(m: list[Column], n: list[Column]) -> list[Column]:
    return [m[3 * r] * n[c] + m[3 * r + 1] * n[3 + c] + m[3 * r + 2] * n[6 + c] for r in range(3) for c in range(3)]


def homography(source: Column, target: Column) -> Column:
    """The exact transform of four points to four; null entries if degenerate."""

    def scaled(*m):
        return F.array(*[F.try_divide(v, m[8]) for v in m])

    def composed(*v):
        return let(_times(list(v[9:]), _adjugate(list(v[:9]))), scaled)

    return let([*_entries(_square_to_quad(source)), *_entries(_square_to_quad(target))], composed)


def canvas(width, height) -> Column:
    w, h = F.lit(width) - 1, F.lit(height) - 1
    zero = F.lit(0)
    return F.array(point(zero, zero), point(w, zero), point(w, h), point(zero, h))


def project(points: Column, h: Column) -> Column:
    def one(p):
        w = h[6] * p["x"] + h[7] * p["y"] + h[8]
        return point(F.try_divide(h[0] * p["x"] + h[1] * p["y"] + h[2], w), F.try_divide(h[3] * p["x"] + h[4] * p["y"] + h[5], w))

    return F.transform(points, one)


def invert(h: Column) -> Column:
    """Inverse by adjugate over determinant; null entries if singular."""

    def outer(*m):
        return let([*m[:3], *_adjugate(list(m))], inner)

    def inner(m0, m1, m2, *adj):
        det = m0 * adj[0] + m1 * adj[3] + m2 * adj[6]
        return F.array(*[F.try_divide(v, det) for v in adj])

    return let(_entries(h), outer)


_SQUARE_STEPS = [
    {"dx1": "x1 - x2", "dx2": "x3 - x2", "sx": "x0 - x1 + x2 - x3", "dy1": "y1 - y2", "dy2": "y3 - y2", "sy": "y0 - y1 + y2 - y3"},
    {"den": "dx1 * dy2 - dx2 * dy1"},
    {"g": "try_divide(sx * dy2 - dx2 * sy, den)", "h": "try_divide(dx1 * sy - sx * dy1, den)"},
    {"a": "x1 - x0 + g * x1", "b": "x3 - x0 + h * x3", "d": "y1 - y0 + g * y1", "e": "y3 - y0 + h * y3"},
]
_ADJUGATE = ["e * i - f * h", "c * h - b * i", "b * f - c * e", "f * g - d * i", "a * i - c * g", "c * d - a * f", "d * h - e * g", "b * g - a * h", "a * e - b * d"]


def _staged(df: DataFrame, start: dict[str, Column], steps: list[dict[str, str]], output: str, entries: list[str]) -> DataFrame:
    """Steps over named values as columns of their own, each computed once and
    compiled with the rest of the stage; only `output`, an array, stays."""
    own, held = set(df.columns), dict(start)
    names = {n: f"__{n}" for step in [start, *steps] for n in step}
    if own & set(names.values()):
        raise ValueError("a column's name begins with two underscores")

    def named(e: str) -> Column:
        return F.expr(re.sub(r"\b[a-z]+[0-9]?\b", lambda m: names.get(m[0], m[0]), e))

    df = df.withColumns({names[n]: c.cast("double") for n, c in held.items()})
    for step in steps:
        df = df.withColumns({names[n]: named(e) for n, e in step.items()})
    return df.withColumn(output, F.array(*[named(e) for e in entries])).drop(*set(names.values()))


def with_canvas_homography(df: DataFrame, quad: str, width: int, height: int, output: str) -> DataFrame:
    """homography() of a column of quads to a canvas, for whole tables."""
    start = {f"{a}{i}": F.col(quad)[i][a] for i in range(4) for a in "xy"}
    plain = {"c": "x0", "f": "y0", "i": "1D"}
    adjugate = {f"m{k}": e for k, e in enumerate(_ADJUGATE)}
    scale = [f"{float(width - 1)}D * "] * 3 + [f"{float(height - 1)}D * "] * 3 + [""] * 3
    return _staged(df, start, [*_SQUARE_STEPS, plain, adjugate], output, [f"try_divide({s}m{k}, m8)" for k, s in enumerate(scale)])


def with_homography(df: DataFrame, source: Column | list[Column], target: Column | list[Column], output: str) -> DataFrame:
    """homography() of two quads of four points each, for whole tables; `output` and a
    number name two columns on the way."""
    square = ["a", "b", "x0", "d", "e", "y0", "g", "h", "1D"]
    sides = [f"{output}0", f"{output}1"]
    for side, quad in zip(sides, (source, target), strict=True):
        df = _staged(df, {f"{a}{i}": quad[i][a] for i in range(4) for a in "xy"}, _SQUARE_STEPS, side, square)
    start = {n: F.col(sides[0])[k] for k, n in enumerate("abcdefghi")} | {f"n{k}": F.col(sides[1])[k] for k in range(9)}
    adjugate = {f"m{k}": e for k, e in enumerate(_ADJUGATE)}
    times = {f"p{3 * r + c}": f"n{3 * r} * m{c} + n{3 * r + 1} * m{3 + c} + n{3 * r + 2} * m{6 + c}" for r in range(3) for c in range(3)}
    return _staged(df, start, [adjugate, times], output, [f"try_divide(p{k}, p8)" for k in range(9)]).drop(*sides)


def with_inverse(df: DataFrame, transform: str, output: str) -> DataFrame:
    """invert() of a column of transforms, for whole tables."""
    start = {n: F.col(transform)[k] for k, n in enumerate("abcdefghi")}
    adjugate = {f"m{k}": e for k, e in enumerate(_ADJUGATE)}
    return _staged(df, start, [adjugate, {"det": "a * m0 + b * m3 + c * m6"}], output, [f"try_divide(m{k}, det)" for k in range(9)])


def components(h: Column) -> Column:
    """Motion of a transform; a null transform gives eight NaN."""
    names = ["translation_x", "translation_y", "rotation_deg", "scale_x", "scale_y", "scale_avg", "perspective_x", "perspective_y"]
    sx, sy = F.hypot(h[0], h[3]), F.hypot(h[1], h[4])
    values = [h[2], h[5], F.degrees(F.atan2(h[3], h[0])), sx, sy, (sx + sy) / 2, h[6], h[7]]
    return F.struct(*[F.when(h.isNull(), F.lit(NAN)).otherwise(v).alias(n) for n, v in zip(names, values, strict=True)])


def similarity(tx: Column, ty: Column, degrees: Column, scale: Column) -> Column:
    r = F.radians(degrees)
    c, s = F.cos(r) * scale, F.sin(r) * scale
    zero = F.lit(0.0)
    return F.array(c, -s, tx, s, c, ty, zero, zero, F.lit(1.0))


def step_limited(previous: Column, target: Column, most: float) -> Column:
    if most <= 0:
        return target
    return previous + F.greatest(F.lit(-most), F.least(F.lit(most), target - previous))


def normalize_line_angle(angle: Column) -> Column:
    """Into (-90, 90]."""
    return 90 - F.pmod(90 - angle, F.lit(180.0))


def segment(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.struct(F.hypot(dx, dy).alias("length"), normalize_line_angle(F.degrees(F.atan2(dy, dx))).alias("angle"))


def box_sides(width: Column, height: Column, angle: Column) -> Column:
    """A rotated box's long and short side and its long side's angle."""
    turned = F.when(width < height, angle + 90).otherwise(angle)
    return F.struct(F.greatest(width, height).alias("long"), F.least(width, height).alias("short"), normalize_line_angle(turned).alias("angle"))


def fill_and_aspect(contour_area: Column, width: Column, height: Column) -> Column:
    return F.struct(
        (contour_area / F.greatest(width * height, F.lit(1.0))).alias("fill"),
        (F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1.0))).alias("aspect"),
    )


def frame_time(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0, frame / fps)


def nearest_frame(seconds: Column, fps: Column, frames: Column) -> Column:
    """Half to even, held within the video."""
    return F.greatest(F.lit(0), F.least(F.bround(seconds * fps), frames - 1)).cast("long")


def crop_box(width: Column, height: Column, left, top, right, bottom) -> Column:
    """Pixel box of the shares cut from each side; an empty one is an error."""
    x0, x1 = F.bround(width * F.lit(left)).cast("long"), F.bround(width * (1 - F.lit(right))).cast("long")
    y0, y1 = F.bround(height * F.lit(top)).cast("long"), F.bround(height * (1 - F.lit(bottom))).cast("long")
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when((x0 >= x1) | (y0 >= y1), F.raise_error(F.lit("the crop is empty")).cast("struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>")).otherwise(box)


def display_scale(width: Column, height: Column, most_width, most_height) -> Column:
    return F.least(F.lit(most_width) / width, F.lit(most_height) / height, F.lit(1.0))


def tile_height(width: Column, height: Column, tile_width) -> Column:
    return F.greatest(F.lit(1), F.bround(height * F.lit(tile_width) / width)).cast("long")


def canvas_to_frame(p: Column, scale: Column, width: Column, height: Column) -> Column:
    return point(F.greatest(F.lit(0.0), F.least(p["x"] / scale, width - 1)), F.greatest(F.lit(0.0), F.least(p["y"] / scale, height - 1)))


def frame_to_canvas(p: Column, scale: Column) -> Column:
    return point(p["x"] * scale, p["y"] * scale)
