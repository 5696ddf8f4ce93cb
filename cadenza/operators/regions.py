"""Regions of masks as rows: runs, connected labels, areas, boxes.

A mask is a table of its set pixels (*key, x, y), whole numbers from 0. Rows of
pixels become runs by gaps and islands; runs of neighbouring rows meet in an
equi-join on (key, row, bucket of columns); labels come from components(). So a
mask of any size is spread over tasks, and a row of pixels is one partition's
window, not a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import written
from .gates import boxes_intersect, component_ok
from .hulls import convex_hull, least_box
from .labels import components

#: Columns of a bucket in which runs of neighbouring rows meet.
BUCKET = 64


def row_runs(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(*key, y, x0, x1): maximal runs of set pixels, ends included; a pixel
    that is given twice counts once."""
    w = Window.partitionBy(*key, "y").orderBy("x")
    island = pixels.select(*key, "y", "x").distinct().withColumn("__i", F.col("x") - F.row_number().over(w))
    return island.groupBy(*key, "y", "__i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__i")


def gaps(runs: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """(*key, y, x0, x1): what runs leave of frames(*key, width, height) and of a
    margin of one pixel around them."""
    rows = frames.select(*key, "width", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("height").cast("long"))).alias("y"))
    ends = rows.select(*key, "y", (F.col("width") + 1).cast("long").alias("x0"), F.col("width").cast("long").alias("x1"))
    w = Window.partitionBy(*key, "y").orderBy("x0")
    both = runs.select(*key, "y", "x0", "x1").unionByName(ends)
    out = both.select(*key, "y", (F.coalesce(F.lag("x1").over(w), F.lit(-2)) + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    return out.filter("x0 <= x1")


def _number(y: str, x: str) -> Column:
    """A run's number within its frame: by row, then first column."""
    return ((F.col(y) + 1) * F.lit(1 << 32) + F.col(x) + 1).cast("long")


def _overlaps(runs: DataFrame, key: list[str], reach: int) -> DataFrame:
    """Pairs of runs of neighbouring rows, the upper one's columns with an `a`,
    that overlap or, with a reach of one, touch at a corner. Each run stands in
    every bucket it reaches; a pair counts in the first bucket of both."""
    bucket = lambda c: F.floor(c / BUCKET).cast("long")
    spread = lambda df, low, high: df.withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    up = spread(runs.select(*key, F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), (F.col("y") + 1).alias("y")), F.col("a0") - reach, F.col("a1") + reach)
    down = spread(runs.select(*key, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1")), F.col("b0"), F.col("b1"))
    met = up.join(down, [*key, "y", "__b"]).filter((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach))
    return met.filter(F.col("__b") == bucket(F.greatest(F.col("a0") - reach, F.col("b0")))).drop("__b")


def labelled(runs: DataFrame, key: list[str], corners: bool = True) -> DataFrame:
    """runs with `label`, the number of the first run (by row, then column) of
    their connected region; with corners, pixels that touch at one are
    connected."""
    met = _overlaps(runs, key, int(corners)).select(*key, _number("ya", "a0").alias("a"), _number("y", "b0").alias("b"))
    roots = components(met, key)
    named = runs.withColumn("node", _number("y", "x0")).join(roots, [*key, "node"], "left")
    return named.withColumn("label", F.coalesce("root", "node")).drop("node", "root")


def outer_regions(runs: DataFrame, frames: DataFrame, key: list[str]) -> DataFrame:
    """(*key, y, x0, x1, label): the regions that are seen from the frame's edge,
    their holes filled, with all that lies in these. What isn't connected (by
    sides) to the margin is such a region or inside one."""
    around = written(labelled(gaps(runs, frames, key), key, corners=False), "around")
    first = around.groupBy(*key).agg(F.min("label").alias("label"))
    outside = around.join(first, [*key, "label"], "left_semi")
    inside = gaps(outside.select(*key, "y", "x0", "x1"), frames, key)
    return labelled(inside.filter((F.col("y") >= 0) & (F.col("x0") >= 0)), key)


def region_areas(regions: DataFrame, key: list[str]) -> DataFrame:
    """(*key, label, area): the area within the polygon through the centres of a
    filled region's outer pixels. Of each two-by-two window four set pixels give
    one and three give a half; so two overlapping runs of neighbouring rows give
    their overlap's steps, and a half for each end that isn't the same."""
    label = regions.select(*key, F.col("y").alias("ya"), F.col("x0").alias("a0"), "label")
    met = _overlaps(regions, key, 0).join(label, [*key, "ya", "a0"])
    steps = F.least("a1", "b1") - F.greatest("a0", "b0")
    uneven = (F.col("a0") != F.col("b0")).cast("int") + (F.col("a1") != F.col("b1")).cast("int")
    inner = met.groupBy(*key, "label").agg(F.sum(steps + uneven / 2).alias("area"))
    return regions.select(*key, "label").distinct().join(inner, [*key, "label"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def component_candidates(pixels: DataFrame, frames: DataFrame, key: list[str], selection: Column, angle_limit: float = 3.0, least_long: float = 0.0, least_short: float = 0.0, least_area: float = 0.002) -> DataFrame:
    """(*key, label, pixels, area, x0, y0, x1, y1, long, short, angle, fill,
    aspect, length, accepted) of every outer region of masks: its filled pixels,
    outline area, upright box (ends exclusive), least-area box and whether it can
    be a line within `selection`, a struct x0, y0, x1, y1. fill and aspect are by the
    box's area and its sides' ratio, each one division, so that they are exact at
    their bounds; an area or a short side under one counts as one. length is the
    long side times the fill, at most one."""
    regions = written(outer_regions(row_runs(pixels, key), frames, key), "regions")
    boxes = regions.groupBy(*key, "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.min("x0").alias("x0"), F.min("y").alias("y0"), (F.max("x1") + 1).alias("x1"), (F.max("y") + 1).alias("y1")
    )
    ends = regions.select(*key, "label", F.col("x0").alias("x"), "y").unionByName(regions.select(*key, "label", F.col("x1").alias("x"), "y"))
    rects = convex_hull(ends, [*key, "label"]).select(*key, "label", least_box(F.col("hull")).alias("rect"))
    rows = boxes.join(region_areas(regions, key), [*key, "label"]).join(rects, [*key, "label"]).join(frames.select(*key, "width", "height"), key)
    sides = G.box_sides(F.col("rect.width"), F.col("rect.height"), F.col("rect.angle"))
    rows = rows.withColumn("s", sides)
    aspect = F.when(F.col("s.short") >= 1, F.col("rect.ratio")).otherwise(F.col("s.long"))
    rows = rows.withColumn("f", F.struct((F.col("area") / F.greatest(F.col("rect.area"), F.lit(1.0))).alias("fill"), aspect.alias("aspect")))
    box = F.struct("x0", "y0", "x1", "y1")
    ok = component_ok(F.col("area"), box, F.col("width"), F.col("height"), boxes_intersect(box, selection), F.col("s.long"), F.col("s.short"), F.col("f.fill"), F.col("f.aspect"), F.col("s.angle"), least_long, least_short, angle_limit, least_area)
    return rows.select(
        *key, "label", "pixels", "area", "x0", "y0", "x1", "y1", "s.long", "s.short", "s.angle", "f.fill", "f.aspect",
        (F.col("s.long") * F.least(F.col("f.fill"), F.lit(1.0))).alias("length"), ok.alias("accepted"),
    )
