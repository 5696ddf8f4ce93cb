"""Greedy choice of points that keep a least distance.

The sequential answer (best first; a point is taken unless a taken one is nearer
than the distance) is reached in rounds over grid cells that hold one taken point
at most: each cell's best undecided point is taken if no better undecided point
is near it, and what is near a taken point falls away. A round is one
aggregation and two equi-joins on cells, where a point meets one candidate of
each cell around it; so a crowd of points in one place costs its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

#: A cell's side as a share of the distance: its diagonal is below one.
_SIDE = 0.7
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]


def _cells(df: DataFrame) -> DataFrame:
    """The rows at their own and the 24 cells around."""
    at = F.array(*[F.struct((F.col("__cx") + i).alias("x"), (F.col("__cy") + j).alias("y")) for i, j in _AROUND])
    return df.withColumn("__c", F.explode(at)).select("*", F.col("__c.x").alias("__ax"), F.col("__c.y").alias("__ay")).drop("__c", "__cx", "__cy")


def _met(rows: DataFrame, chosen: DataFrame, key: list[str], near: Column):
    """Join of undecided rows (alias p) and chosen ones at all cells around
    (alias c) that are nearer than the distance."""
    same = (F.col("p.__cx") == F.col("c.__ax")) & (F.col("p.__cy") == F.col("c.__ay"))
    for k in key:
        same = same & F.col(f"p.`{k}`").eqNullSafe(F.col(f"c.`{k}`"))
    return rows.alias("p"), _cells(chosen).alias("c"), same & near


def spaced_points(points: DataFrame, key: list[str], quality: str, order: str, distance: float, most: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """The taken points of each group with their `rank` from 1: greatest quality
    first, of equals the least `order`, which is unique in a group; `most` of
    them at most. A point nearer than `distance` to a taken one is left out, one
    at exactly that distance isn't. Points with a null or NaN place or quality are
    never taken."""
    cell = lambda c: F.floor(F.col(c) / (distance * _SIDE)).cast("long")
    known = F.lit(True)
    for c in (x, y, quality):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = points.filter(known).withColumns({"__cx": cell(x), "__cy": cell(y), "__by": F.struct(-F.col(quality), F.col(order))})
    slim = rows.select(*key, "__cx", "__cy", "__by", F.col(x).alias("__x"), F.col(y).alias("__y"))
    left, taken, read = written(slim, "spacing"), [], None
    near = (F.col("p.__x") - F.col("c.__x")) ** 2 + (F.col("p.__y") - F.col("c.__y")) ** 2 < distance * distance
    while not left.isEmpty():
        best = left.groupBy(*key, "__cx", "__cy").agg(F.min(F.struct("__by", "__x", "__y")).alias("b")).select(*key, "__cx", "__cy", "b.*")
        p, c, met = _met(left, best, key, near & (F.col("p.__by") < F.col("c.__by")))
        behind = p.join(c, met).select(*[F.col(f"c.`{k}`").alias(k) for k in key], F.col("c.__by").alias("__by")).distinct()
        same = F.col("b.__by") == F.col("n.__by")
        for k in key:
            same = same & F.col(f"b.`{k}`").eqNullSafe(F.col(f"n.`{k}`"))
        now = written(best.alias("b").join(behind.alias("n"), same, "left_anti"), "spacing")
        p, c, met = _met(left, now, key, near)
        rest = written(p.join(c, met, "left_anti"), "spacing")
        drop(left)
        taken.append(now)
        left, read = rest, now if read is None else read.unionByName(now)
    drop(left)
    if read is None:
        return points.filter(F.lit(False)).withColumn("rank", F.lit(1).cast("int"))
    chosen = read.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__by").alias("__taken"))
    same = F.col("__by") == F.col("__taken")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.join(chosen.hint("merge"), same, "left_semi")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("__by")))
    if most is not None:
        out = out.filter(F.col("rank") <= most)
    return out.select(*points.columns, "rank")
