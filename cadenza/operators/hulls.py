"""Convex hulls of many point sets at once, and least-area boxes.

The hull of a union is the hull of the parts' hulls: a set is dealt to chunks of
a bounded number of points, each chunk's hull takes its place, and so on until
every set fits one chunk. A chunk's hull is one expression: over points by x, the
chain kept so far ends at the place from which the new point is seen at the least
(or greatest) slope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import drop, written

CHUNK = 4096


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda's variable holds it."""
    return F.transform(F.array(value), f)[0]


def _chain(columns: Column, side: str, sign: int) -> Column:
    """The lower (sign 1) or upper (-1) hull of structs x, lo, hi with different
    x in order: of places seen at the same slope the first stays."""

    def grown(kept, p):
        here = F.struct(p["x"].alias("x"), p[side].alias("y"))
        seen = F.transform(kept, lambda v, i: F.struct((sign * (here["y"] - v["y"]) / (here["x"] - v["x"])).alias("slope"), i.alias("i")))
        # a later place is on the chain only if it is seen at a greater slope than the one before it
        last = F.array_max(F.transform(seen, lambda v: F.struct(v["slope"].alias("slope"), (-v["i"]).alias("i"))))["i"]
        return F.concat(F.slice(kept, 1, F.coalesce(1 - last, F.lit(0)).cast("int")), F.array(here))

    return F.aggregate(columns, F.array().cast("array<struct<x:double,y:double>>"), grown)


def hull_of(columns: Column) -> Column:
    """The hull's corners, from the leftmost along the lower side, of structs x,
    lo, hi (the least and greatest y at x) in order of x. Points on a side aren't
    corners; a single point is its own hull."""

    def both(chains):
        low, high = chains["low"], chains["high"]
        m = F.size(high)
        start = F.when(F.element_at(low, -1) == F.element_at(high, 1), 2).otherwise(1)
        stop = F.when(F.element_at(low, 1) == F.element_at(high, -1), m - 1).otherwise(m)
        return F.when(m > 0, F.concat(low, F.slice(high, start, F.greatest(stop - start + 1, F.lit(0)))))

    return bound(F.struct(_chain(columns, "lo", 1).alias("low"), F.reverse(_chain(columns, "hi", -1)).alias("high")), both)


def _columns(points: DataFrame, key: list[str]) -> DataFrame:
    return points.groupBy(*key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))


def convex_hull(points: DataFrame, key: list[str], chunk: int = CHUNK) -> DataFrame:
    """(*key, hull): the corners of the convex hull of each set of points (*key,
    x, y) as an array of points. Points with a null or NaN place are left out; only
    hull corners of a set ever meet in one row."""
    good = points.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    rows, held = _columns(good, key), []
    while True:
        counts = rows.groupBy(*key).agg(F.count("*").alias("__n"))
        most = counts.agg(F.max("__n")).first()[0] or 0
        if most <= chunk:
            break
        many = rows.join(counts, key).withColumn("__c", F.pmod(F.xxhash64("x"), F.ceil(F.col("__n") / chunk)))
        parts = many.groupBy(*key, "__c").agg(F.array_sort(F.collect_list(F.struct("x", "lo", "hi"))).alias("p"))
        corners = parts.select(*key, F.explode(hull_of(F.col("p"))).alias("p")).select(*key, "p.x", "p.y")
        rows = written(_columns(corners, key), "hulls")
        held.append(rows)
        if rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] >= most:
            break  # nearly all points are corners: the hull itself is that large
    whole = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("x", "lo", "hi"))).alias("p"))
    drop(*held[:-1])
    return whole.select(*key, hull_of(F.col("p")).alias("hull"))


def hull_area(hull: Column) -> Column:
    def area(hull):
        n = F.size(hull)
        cross = lambda i: hull[i]["x"] * hull[(i + 1) % n]["y"] - hull[(i + 1) % n]["x"] * hull[i]["y"]
        return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i))) / 2

    return bound(hull, area)


def least_box(hull: Column) -> Column:
    """The box of least area around a hull: struct width, height, angle, area,
    ratio. One of its sides lies along a side of the hull, so each side's direction,
    turned into [0, 90) degrees, is tried; of equal areas the one of least angle.
    width is the side along the angle. area, and ratio of the long side to the short
    one (null if that is zero), are one division each, not made of the sides: around
    whole numbers they are exact where sides have roots. A single point has no
    sides: zeros."""

    def tried(hull, p, i):
        q = hull[(i + 1) % F.size(hull)]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        turned = lambda a, b, c, d: F.when((dx > 0) & (dy >= 0), a).when((dx <= 0) & (dy > 0), b).when((dx < 0) & (dy <= 0), c).otherwise(d)
        ux, uy = turned(dx, dy, -dx, -dy), turned(dy, -dx, -dy, dx)

        def measured(ux, uy):
            along = F.transform(hull, lambda c: c["x"] * ux + c["y"] * uy)
            across = F.transform(hull, lambda c: c["y"] * ux - c["x"] * uy)
            return G.let([F.array_max(along) - F.array_min(along), F.array_max(across) - F.array_min(across), ux, uy], lambda w, h, ux, uy: F.array(w * h / (ux * ux + uy * uy), F.degrees(F.atan2(uy, ux)), w / F.sqrt(ux * ux + uy * uy), h / F.sqrt(ux * ux + uy * uy), F.try_divide(F.greatest(w, h), F.least(w, h))))

        return G.let([ux, uy], measured)

    def best(hull):
        found = F.array_min(F.transform(hull, lambda p, i: tried(hull, p, i)))
        found = F.when(F.size(hull) < 2, F.array(*[F.lit(0.0)] * 4, F.lit(None).cast("double"))).otherwise(found)
        return bound(found, lambda b: F.struct(b[2].alias("width"), b[3].alias("height"), b[1].alias("angle"), b[0].alias("area"), b[4].alias("ratio")))

    return bound(hull, best)
