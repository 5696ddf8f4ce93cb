"""Points in quadrilaterals, by grid cells.

A quadrilateral stands in the cells it touches, a point in its own; they meet in
an equi-join on (key, cell) and are tested exactly. Large quadrilaterals take
coarser cells: each has the level at which its box covers few cells, and a point
looks at one cell of each level in use. So no quadrilateral is spread over more
than (COVER + 1)^2 cells, and it meets few points that it doesn't hold: the pairs
tried grow with the pairs found. A row of a cell also says which edges the whole
cell is on one side of: most pairs need the test of no edge or one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along each side of a box at most, less one. Finer cells are more rows, but
#: fewer pairs that are tried in vain: at 16, 1.6 for each found on check_s, at 4, 3.1.
COVER = 16

#: The corners in plain columns: with an array's entries the join's generated
#: method is too long for the JVM to compile (8,000 bytes), 18 us for a pair.
_CORNERS = [(f"__x{i}", f"__y{i}") for i in range(4)]

#: A settled bit: the cell is within the box.
_BOXED = 256


def _edges() -> list[tuple[Column, Column, Column, Column]]:
    """x and y of each edge's start, and its direction."""
    at = [(F.col(x), F.col(y)) for x, y in _CORNERS]
    return [(px, py, qx - px, qy - py) for (px, py), (qx, qy) in zip(at, at[1:] + at[:1], strict=True)]


def _all(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def _extremes(x0: Column, x1: Column, y0: Column, y1: Column) -> tuple[list[Column], list[Column]]:
    """The most and the least of each turn in a cell: they are at corners of it,
    also as rounded, since each step of a turn is monotonic."""
    most, least = [], []
    for px, py, dx, dy in _edges():
        ahead, up = dx >= 0, dy >= 0
        most.append(dx * (F.when(ahead, y1).otherwise(y0) - py) - dy * (F.when(up, x0).otherwise(x1) - px))
        least.append(dx * (F.when(ahead, y0).otherwise(y1) - py) - dy * (F.when(up, x1).otherwise(x0) - px))
    return most, least


def _touches(*cell: Column) -> Column:
    """False only where inside() is at no place of the cell."""
    most, least = _extremes(*cell)
    return _all([t >= 0 for t in most]) | _all([t <= 0 for t in least])


def _settled(*cell: Column) -> Column:
    """Bits of what inside() needn't test in the cell: 0 to 3 and 4 to 7 for the
    turns nowhere below and nowhere above zero."""
    most, least = _extremes(*cell)
    return reduce(Column.__add__, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate([t >= 0 for t in least] + [t <= 0 for t in most])])


def inside(x: Column, y: Column, settled: Column) -> Column:
    """Within a convex quadrilateral or on its edge, in whichever direction its
    corners go."""
    turns = [dx * (y - py) - dy * (x - px) for px, py, dx, dy in _edges()]
    known = [settled.bitwiseAND(1 << k) != 0 for k in range(8)]
    return _all([k | (t >= 0) for k, t in zip(known[:4], turns, strict=True)]) | _all([k | (t <= 0) for k, t in zip(known[4:], turns, strict=True)])


def points_in_quads(points: DataFrame, quads: DataFrame, key: list[str], quad: str = "quad", x: str = "x", y: str = "y") -> DataFrame:
    """All pairs of points and convex quadrilaterals (arrays of four points) of
    the same key that hold them. Their other columns have different names. A
    null or NaN place is in none; a quadrilateral without extent holds the points
    on it."""
    names = [c for pair in _CORNERS for c in pair]
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    # What is there, as a column without nulls: no test for them in the join.
    known = lambda c: F.coalesce(c, F.lit(0.0))
    # exploded: its value, in place of a copy of its expression for each use
    good = quads.withColumn("__quad", F.explode(F.array(quad)))
    good = good.withColumns({c: F.col("__quad")[i][a] for i, pair in enumerate(_CORNERS) for c, a in zip(pair, "xy", strict=True)}).drop("__quad").filter(_all([there(c) for c in names]))
    xs, ys = names[::2], names[1::2]
    low = {"x": F.least(*xs), "y": F.least(*ys)}
    high = {"x": F.greatest(*xs), "y": F.greatest(*ys)}
    extent = F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(1e-9))
    good = good.withColumn("__level", F.ceil(F.log2(extent / COVER)).cast("int"))
    side = F.pow(F.lit(2.0), F.col("__level"))
    cell = lambda c: F.floor(c / side).cast("long")
    spread = good.withColumn("__side", side)
    for a in "xy":
        spread = spread.withColumn(f"__c{a}", F.explode(F.sequence(cell(low[a]), cell(high[a]))))
    bounds = [(F.col(f"__c{a}") + k) * F.col("__side") for a in "xy" for k in (0, 1)]
    boxed = _all([(low[a] <= bounds[k]) & (high[a] >= bounds[k + 1]) for k, a in ((0, "x"), (2, "y"))])
    settled = _settled(*bounds) + F.when(boxed, _BOXED).otherwise(0)
    spread = spread.filter(_touches(*bounds)).withColumn("__settled", F.explode(F.array(settled))).drop("__side").withColumns({c: known(c) for c in names})
    levels = good.select(*key, "__level").distinct()
    here = points.filter(there(x) & there(y)).withColumns({"__px": known(x), "__py": known(y)}).join(levels, key).withColumns({"__cx": cell(F.col("__px")), "__cy": cell(F.col("__py"))})
    px, py = F.col("__px"), F.col("__py")
    # The points of a cell are the few that a merge keeps for each row.
    held = inside(px, py, F.col("__settled")) & ((F.col("__settled") >= _BOXED) | px.between(low["x"], high["x"]) & py.between(low["y"], high["y"]))
    met = spread.join(here, [*key, "__level", "__cx", "__cy"]).filter(held)
    return met.select(*key, *[c for c in points.columns if c not in key], *[c for c in quads.columns if c not in key])
