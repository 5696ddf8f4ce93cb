"""Line segments from edge pixels by voting, as one plan.

A pixel votes for each line direction at its offset; votes are counted in two
stages (before and after the shuffle), peaks are bins that no bin beside them
beats, and the pixels of a peak's line are cut into segments where they leave a
gap. Offsets are computed in whole numbers, so a pixel's bin is the same
everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Cosines and sines are kept to this many parts.
SCALE = 1 << 20


def directions(angles: list[float]) -> list[tuple[int, float, int, int]]:
    """(number, degrees, cosine, sine) of line directions, in parts of SCALE."""
    return [(k, float(a), round(math.cos(math.radians(a)) * SCALE), round(math.sin(math.radians(a)) * SCALE)) for k, a in enumerate(angles)]


def _voting(pixels: DataFrame, key: list[str], angles: list[float]) -> DataFrame:
    """Each pixel in each direction: the line's distance from the origin (to the
    whole pixel), and the place along it."""
    table = F.array(*[F.struct(F.lit(k).alias("direction"), F.lit(c).alias("c"), F.lit(s).alias("s")) for k, _, c, s in directions(angles)])
    rows = pixels.select(*key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.explode(table).alias("d"))
    offset = F.floor((F.col("y") * F.col("d.c") - F.col("x") * F.col("d.s") + SCALE // 2) / SCALE).cast("long")
    return rows.select(*key, "x", "y", F.col("d.direction").alias("direction"), offset.alias("offset"), (F.col("x") * F.col("d.c") + F.col("y") * F.col("d.s")).alias("along"))


def peaks(votes: DataFrame, key: list[str], threshold: int) -> DataFrame:
    """Of votes(*key, direction, offset, n) the bins with at least `threshold`
    that none of the eight around beats; of equals the first by direction, then
    offset, counts. A bin tells its neighbours of itself, so this is one
    aggregation."""
    strong = votes.filter(F.col("n") >= threshold)
    own = F.struct(F.col("n"), (-F.col("direction")).alias("d"), (-F.col("offset")).alias("o"))
    told = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = strong.select(*key, own.alias("own"), F.explode(told).alias("t"), "direction", "offset")
    sent = sent.select(*key, (F.col("direction") + F.col("t.i")).alias("direction"), (F.col("offset") + F.col("t.j")).alias("offset"), "own", ((F.col("t.i") == 0) & (F.col("t.j") == 0)).alias("self"))
    best = sent.groupBy(*key, "direction", "offset").agg(F.max("own").alias("best"), F.max(F.when(F.col("self"), F.col("own"))).alias("own"))
    return best.filter("own = best").select(*key, "direction", "offset", F.col("own.n").alias("votes"))


def line_segments(pixels: DataFrame, key: list[str], angles: list[float], threshold: int = 110, least_length: float = 140.0, gap: float = 18.0) -> DataFrame:
    """(*key, direction, offset, votes, x0, y0, x1, y1, pixels, length, angle):
    the segments of each peak's line, between pixels that are more than `gap`
    apart along it, of at least `least_length` from end to end; angle is that of the
    ends, in (-90, 90]. A pixel given twice counts once."""
    voting = _voting(pixels.select(*key, "x", "y").distinct(), key, angles)
    found = peaks(voting.groupBy(*key, "direction", "offset").agg(F.count("*").alias("n")), key, threshold)
    on = voting.join(found, [*key, "direction", "offset"])
    w = Window.partitionBy(*key, "direction", "offset").orderBy("along", "x", "y")
    apart = (F.col("along") - F.lag("along").over(w)) > int(gap * SCALE)
    cut = on.withColumn("__new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("along", "x", "y")
    ends = cut.groupBy(*key, "direction", "offset", "votes", "__part").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("pixels"))
    measured = ends.withColumn("s", G.segment(G.point(F.col("a.x"), F.col("a.y")), G.point(F.col("b.x"), F.col("b.y"))))
    out = measured.filter(F.col("s.length") >= least_length)
    return out.select(*key, "direction", "offset", "votes", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), "pixels", "s.length", "s.angle")
