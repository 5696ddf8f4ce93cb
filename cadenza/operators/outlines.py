"""Closed outlines reduced to few corners, many at once.

An outline is split at the corner farthest from its first point and at the one
farthest from that; then each piece is split at its point farthest from the
piece's chord, as long as that is farther than the tolerance. All pieces of all
outlines are split in one round: an aggregation and a join on (key, piece); rounds
grow with the depth of splitting, not with points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import drop, written

#: Shares of an outline's length that are tried in turn (fixed values).
TOLERANCES = [0.010, 0.012, 0.015, 0.018, 0.020, 0.025, 0.030, 0.040]


def _far(x: str, y: str, a: str, b: str) -> Column:
    """Distance from the line through a and b (structs x, y); from the point
    where they are one."""
    dx, dy = F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y")
    ox, oy = F.col(x) - F.col(f"{a}.x"), F.col(y) - F.col(f"{a}.y")
    return F.coalesce(F.try_divide(F.abs(dx * oy - dy * ox), F.hypot(dx, dy)), F.hypot(ox, oy))


def _farthest(points: DataFrame, key: list[str], start: DataFrame, name: str) -> DataFrame:
    """(*key, name): the point (i, x, y) farthest from each key's `start`; of
    equals the least i."""
    far = points.join(start, key).withColumn("__d", F.hypot(F.col("x") - F.col("start.x"), F.col("y") - F.col("start.y")))
    return far.groupBy(*key).agg(F.min_by(F.struct("i", "x", "y"), F.struct(-F.col("__d"), F.col("i"))).alias(name))


def simplified(points: DataFrame, key: list[str], tolerances: list[float] | None = None) -> DataFrame:
    """(*key, tolerance, corners) of outlines of points(*key, i, x, y), i from 0
    without gaps: for each tolerance, a share of the outline's length, the corners
    that stay, an array of structs i, x, y in the outline's order from its first
    corner. Places aren't null. An outline of one place keeps one point."""
    shares = tolerances or TOLERANCES
    w = Window.partitionBy(*key).orderBy("i")
    whole = Window.partitionBy(*key)
    rows = points.select(*key, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    nxt = [F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in "xy"]
    rows = rows.withColumns({"__step": F.hypot(nxt[0] - F.col("x"), nxt[1] - F.col("y")), "n": F.count("*").over(whole)})
    rows = written(rows.withColumn("length", F.sum("__step").over(whole)).drop("__step"), "outline")
    first = rows.filter("i = 0").select(*key, F.struct("x", "y").alias("start"))
    a = _farthest(rows, key, first, "a")
    b = _farthest(rows, key, a.select(*key, F.col("a").alias("start")), "b")
    ends = written(a.join(b, key), "outline")
    at = rows.join(ends, key).withColumn("pos", F.pmod(F.col("i") - F.col("a.i"), F.col("n"))).withColumn("mid", F.pmod(F.col("b.i") - F.col("a.i"), F.col("n")))
    tolerance = F.explode(F.array(*[F.lit(float(t)) for t in shares])).alias("tolerance")
    first_half = F.col("pos") < F.col("mid")
    left = at.filter("pos > 0 and pos <> mid").select(
        *key, tolerance, "i", "x", "y", "pos", "length",
        F.when(first_half, F.lit(0)).otherwise(F.col("mid")).alias("piece"),
        F.when(first_half, F.struct("a.x", "a.y")).otherwise(F.struct("b.x", "b.y")).alias("s"),
        F.when(first_half, F.struct("b.x", "b.y")).otherwise(F.struct("a.x", "a.y")).alias("e"),
    )
    corner = lambda c: F.struct(F.col(f"{c}.i").alias("i"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y"))
    kept = [ends.select(*key, tolerance, corner("a").alias("c")), ends.filter("a.i <> b.i").select(*key, tolerance, corner("b").alias("c"))]
    left, held = written(left, "outline"), []
    by = [*key, "tolerance", "piece"]
    while not left.isEmpty():
        measured = left.withColumn("__d", _far("x", "y", "s", "e"))
        cut = measured.groupBy(*by).agg(F.min_by(F.struct("i", "x", "y", "pos"), F.struct(-F.col("__d"), F.col("pos"))).alias("c"), F.max(F.col("__d") - F.col("tolerance") * F.col("length")).alias("over"))
        cut = written(cut.filter("over > 0").drop("over"), "outline")
        held.append(cut)
        kept.append(cut.select(*key, "tolerance", corner("c").alias("c")))
        again = left.join(cut, by).filter(F.col("pos") != F.col("c.pos"))
        before = F.col("pos") < F.col("c.pos")
        here = F.struct("c.x", "c.y")
        rest = written(again.select(
            *key, "tolerance", "i", "x", "y", "pos", "length", F.when(before, F.col("piece")).otherwise(F.col("c.pos")).alias("piece"),
            F.when(before, F.col("s")).otherwise(here).alias("s"), F.when(before, here).otherwise(F.col("e")).alias("e"),
        ), "outline")
        drop(left)
        left = rest
    drop(left)
    found = kept[0]
    for k in kept[1:]:
        found = found.unionByName(k)
    return found.groupBy(*key, "tolerance").agg(F.array_sort(F.collect_list("c")).alias("corners"))


def screen_outlines(points: DataFrame, key: list[str], width: float, height: float, tolerances: list[float] | None = None) -> DataFrame:
    """(*key, tolerance, quad): the first tolerance at which an outline has four
    corners that form a valid screen, and these in order; outlines without one are
    left out."""
    four = simplified(points, key, tolerances).filter(F.size("corners") == 4)
    quads = four.withColumn("quad", F.explode(F.array(G.order_corners(F.transform("corners", lambda c: G.point(c["x"], c["y"]))))))
    valid = quads.filter(G.quad_is_valid(F.col("quad"), width, height))
    return valid.groupBy(*key).agg(F.min(F.struct("tolerance", "quad")).alias("m")).select(*key, "m.tolerance", "m.quad")
