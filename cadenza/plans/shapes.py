"""The catalogue's third part: shapes found in masks and point sets, as plans.

Four embeddings make a frame of 16 by 16 pixels (a value over 0.07 is set), one
makes 32 points or eight quadrilaterals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import containment as C
from ..operators import hough as L
from ..operators import hulls as H
from ..operators import outlines as O
from ..operators import regions as R
from ..operators.robust import robust_homographies as fitted_homographies
from ..operators.spacing import spaced_points as spaced
from .catalogue import _ORDERED, _POINTS, _points, _quads, _r, once, query, read, rounded

_SIDE = 16


def _mask(spark, d):
    """(frame, x, y) of set pixels, and (frame, width, height)."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).filter("v > 0.07")
    pixels = e.select(F.expr("vec_id div 4").alias("frame"), (F.col("i") % _SIDE).cast("long").alias("x"), (F.col("vec_id") % 4 * 4 + F.expr(f"i div {_SIDE}")).alias("y"))
    frames = read(spark, d, "embeddings").select(F.expr("vec_id div 4").alias("frame")).distinct()
    return pixels, frames.withColumns({"width": F.lit(_SIDE), "height": F.lit(_SIDE)})


_PIXELS = f"px AS (SELECT DISTINCT vec_id // 4 AS frame, i % {_SIDE} AS x, (vec_id % 4) * 4 + i // {_SIDE} AS y FROM embeddings, range(0, 64) t(i) WHERE embedding[i + 1] > CAST(0.07 AS DOUBLE))"
#: Flooded from the margin; what stays is labelled by the least pixel reached.
_REGIONS = f"""{_PIXELS}, cell AS MATERIALIZED (SELECT f.frame, f.x, f.y, px.x IS NOT NULL AS lit FROM (SELECT frame, x, y FROM (SELECT DISTINCT vec_id // 4 AS frame FROM embeddings), range(-1, {_SIDE + 1}) a(x), range(-1, {_SIDE + 1}) b(y)) f LEFT JOIN px ON px.frame = f.frame AND px.x = f.x AND px.y = f.y),
outside AS (SELECT frame, x, y FROM cell WHERE x = -1 AND y = -1
  UNION SELECT c.frame, c.x, c.y FROM outside o, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dx, dy), cell c WHERE c.frame = o.frame AND c.x = o.x + dx AND c.y = o.y + dy AND NOT c.lit),
inside AS MATERIALIZED (SELECT frame, x, y, (y + 1) * 4294967296 + x + 1 AS k FROM cell ANTI JOIN outside USING (frame, x, y)),
step AS MATERIALIZED (SELECT a.frame, a.k AS a, b.k AS b FROM inside a, range(-1, 2) s(dx), range(-1, 2) t(dy), inside b WHERE b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy),
reach AS (SELECT frame, k AS a, k AS b FROM inside UNION SELECT r.frame, r.a, s.b FROM reach r JOIN step s ON s.frame = r.frame AND s.a = r.b),
region AS MATERIALIZED (SELECT i.frame, i.x, i.y, m.label FROM inside i JOIN (SELECT frame, b AS k, min(a) AS label FROM reach GROUP BY 1, 2) m USING (frame, k))"""
_AREAS = """win AS (SELECT frame, label, x - dx AS wx, y - dy AS wy, count(*) AS n FROM region, range(0, 2) s(dx), range(0, 2) t(dy) GROUP BY 1, 2, 3, 4),
areas AS (SELECT frame, label, CAST(sum(CASE n WHEN 4 THEN 1.0 WHEN 3 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS area FROM win GROUP BY 1, 2)"""


def _box_sql(points: str, key: str) -> str:
    """The least-area box of points(key, x, y) by all pairs' directions."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in key.split(", "))
    p = ", ".join(f"p.{k}" for k in key.split(", "))
    return f"""dir AS (SELECT DISTINCT {p}, q.x - p.x AS dx, q.y - p.y AS dy FROM {points} p JOIN {points} q ON {on('p', 'q')} WHERE q.x <> p.x OR q.y <> p.y),
turned AS (SELECT DISTINCT {key}, CASE WHEN dx > 0 AND dy >= 0 THEN dx WHEN dx <= 0 AND dy > 0 THEN dy WHEN dx < 0 AND dy <= 0 THEN -dx ELSE -dy END AS ux, CASE WHEN dx > 0 AND dy >= 0 THEN dy WHEN dx <= 0 AND dy > 0 THEN -dx WHEN dx < 0 AND dy <= 0 THEN -dy ELSE dx END AS uy FROM dir),
extent AS (SELECT {p}, ux, uy, max(p.x * ux + p.y * uy) - min(p.x * ux + p.y * uy) AS w, max(p.y * ux - p.x * uy) - min(p.y * ux - p.x * uy) AS h FROM {points} p JOIN turned t ON {on('p', 't')} GROUP BY ALL),
tried AS (SELECT {key}, w * h * 1.0 / (ux * ux + uy * uy) AS box, degrees(atan2(uy, ux)) AS turn, w / sqrt(ux * ux + uy * uy) AS w, h / sqrt(ux * ux + uy * uy) AS h, greatest(w, h) / least(w, h) AS ratio FROM extent),
rect AS (SELECT {key}, arg_min({{'w': w, 'h': h, 'turn': turn, 'box': box, 'ratio': ratio}}, [box, turn]) AS r FROM tried GROUP BY {key})"""


_SIDES = "greatest(w, h) AS long, least(w, h) AS short, 90 - ((90 - CASE WHEN w < h THEN turn + 90 ELSE turn END) - 180.0 * floor((90 - CASE WHEN w < h THEN turn + 90 ELSE turn END) / 180.0)) AS angle"


@query(f"""WITH RECURSIVE {_REGIONS}, {_AREAS}, ends AS MATERIALIZED (SELECT frame, label, y, min(x) AS x FROM region GROUP BY 1, 2, 3 UNION SELECT frame, label, y, max(x) FROM region GROUP BY 1, 2, 3),
{_box_sql('ends', 'frame, label')}, b AS (SELECT frame, label, count(*) AS pixels, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM region GROUP BY 1, 2),
j AS (SELECT b.*, area, coalesce(r.w, 0.0) AS w, coalesce(r.h, 0.0) AS h, coalesce(r.turn, 0.0) AS turn, coalesce(r.box, 0.0) AS box, r.ratio AS ratio FROM b JOIN areas USING (frame, label) LEFT JOIN rect USING (frame, label)),
s AS (SELECT *, {_SIDES}, area / greatest(box, 1.0) AS fill, CASE WHEN least(w, h) >= 1 THEN ratio ELSE greatest(w, h) END AS aspect FROM j)
SELECT frame, label, pixels, area, x0, y0, x1, y1, {', '.join(f'{_r(c)} AS "{c}"' for c in ('long', 'short', 'angle', 'fill', 'aspect'))}, {_r('long * least(fill, 1.0)')} AS length,
  area >= 0.01 * 256 AND long >= 2.5 AND short >= 1.0 AND x0 < 14 AND x1 > 2 AND y0 < 12 AND y1 > 2 AND NOT ((x0 <= 1 OR y0 <= 1 OR x1 >= 15 OR y1 >= 15) AND (x1 - x0 > 16 * 0.9 OR y1 - y0 > 16 * 0.9))
  AND fill >= 0.35 AND aspect >= 1.2 AND abs(angle) <= 50 AS accepted FROM s""")
def component_candidates(spark, d):
    """Outer regions of masks, their holes filled, and which can be a line."""
    pixels, frames = _mask(spark, d)
    band = F.struct(F.lit(2).alias("x0"), F.lit(2).alias("y0"), F.lit(14).alias("x1"), F.lit(12).alias("y1"))
    return rounded(R.component_candidates(pixels, frames, ["frame"], band, 50.0, 2.5, 1.0, 0.01))


@query(f"""WITH {_POINTS}, side AS (SELECT p.vec_id, p.x, p.y, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON q.vec_id = p.vec_id AND (q.x <> p.x OR q.y <> p.y)
  WHERE NOT EXISTS (SELECT 1 FROM pts r WHERE r.vec_id = p.vec_id AND (r.i <> p.i AND r.i <> q.i) AND (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0)),
{_box_sql('pts', 'vec_id')}, h AS (SELECT vec_id, count(*) AS corners, abs(sum(x * qy - qx * y)) / 2 AS area FROM side GROUP BY 1), s AS (SELECT vec_id, r.w AS w, r.h AS h, r.turn AS turn FROM rect), t AS (SELECT vec_id, w, h, {_SIDES} FROM s)
SELECT h.vec_id, corners, {_r('area')} AS area, {_r('long')} AS "long", {_r('short')} AS short, {_r('angle')} AS angle FROM h JOIN t USING (vec_id)""")
def hull_boxes(spark, d):
    """Convex hulls of point sets and the least boxes around them."""
    hulls = H.convex_hull(_points(spark, d), ["vec_id"], chunk=12).withColumn("box", once(H.least_box(F.col("hull"))))
    rows = hulls.withColumn("s", G.box_sides(F.col("box.width"), F.col("box.height"), F.col("box.angle")))
    return rounded(rows.select("vec_id", F.size("hull").alias("corners"), H.hull_area(F.col("hull")).alias("area"), "s.long", "s.short", "s.angle"))


#: Each frame's mask with a planted line.
_ANGLES = list(range(-45, 50, 5))
_EDGES_SQL = f"{_PIXELS}, edge AS (SELECT frame, x, y FROM px UNION SELECT vec_id // 4, x, vec_id // 4 % 8 + x * (vec_id // 4 % 5) // 10 FROM embeddings, range(0, {_SIDE}) t(x))"
_DIRS = ", ".join(f"({k}, {c}, {s})" for k, _, c, s in L.directions(_ANGLES))
_BEATS = "b.n > a.n OR (b.n = a.n AND (b.d < a.d OR (b.d = a.d AND b.o < a.o)))"


@query(f"""WITH {_EDGES_SQL}, v AS MATERIALIZED (SELECT frame, x, y, d, CAST(floor((y * c - x * s + {L.SCALE // 2}) / {L.SCALE}) AS BIGINT) AS o, x * c + y * s AS along FROM edge, (VALUES {_DIRS}) t(d, c, s)),
n AS MATERIALIZED (SELECT frame, d, o, count(*) AS n FROM v GROUP BY 1, 2, 3 HAVING count(*) >= 7),
peak AS (SELECT * FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.frame = a.frame AND abs(b.d - a.d) <= 1 AND abs(b.o - a.o) <= 1 AND ({_BEATS}))),
l AS (SELECT v.*, n, CASE WHEN along - lag(along) OVER w <= {2 * L.SCALE} THEN 0 ELSE 1 END AS fresh FROM v JOIN peak USING (frame, d, o) WINDOW w AS (PARTITION BY frame, d, o ORDER BY along, x, y)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY frame, d, o ORDER BY along, x, y ROWS UNBOUNDED PRECEDING) AS part FROM l),
e AS (SELECT frame, d AS direction, o AS "offset", n AS votes, count(*) AS pixels, min({{'along': along, 'x': x, 'y': y}}) AS a, max({{'along': along, 'x': x, 'y': y}}) AS b FROM g GROUP BY frame, d, o, n, part),
f AS (SELECT *, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length, degrees(atan2(b.y - a.y, b.x - a.x)) AS t FROM e)
SELECT frame, direction, "offset", votes, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, pixels, {_r('length')} AS length, {_r('90 - ((90 - t) - 180.0 * floor((90 - t) / 180.0))')} AS angle FROM f WHERE length >= 6""")
def hough_segments(spark, d):
    """Segments of the lines for which most pixels of a frame vote."""
    pixels, _ = _mask(spark, d)
    frame = F.expr("vec_id div 4")
    line = read(spark, d, "embeddings").select(frame.alias("frame"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SIDE - 1).cast("long"))).alias("x"))
    line = line.select("frame", "x", (F.col("frame") % 8 + F.expr("(x * (frame % 5)) div 10")).alias("y"))
    return rounded(L.line_segments(pixels.unionByName(line), ["frame"], _ANGLES, 7, 6.0, 2.0))


_SHARES = [0.01, 0.03, 0.06]


def _farthest_sql(name: str, start: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT p.vec_id, arg_min({{'i': p.i, 'x': p.x, 'y': p.y}}, [-sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), p.i]) AS v FROM pts p JOIN ({start}) s USING (vec_id) GROUP BY 1)"


@query(f"""WITH RECURSIVE {_POINTS}, {_farthest_sql('fa', 'SELECT vec_id, x, y FROM pts WHERE i = 0')}, {_farthest_sql('fb', 'SELECT vec_id, v.x AS x, v.y AS y FROM fa')},
len AS (SELECT p.vec_id, sum(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))) AS total FROM pts p JOIN pts q ON q.vec_id = p.vec_id AND q.i = (p.i + 1) % 32 GROUP BY 1),
turn AS MATERIALIZED (SELECT p.vec_id, p.i, p.x, p.y, (p.i - fa.v.i + 32) % 32 AS pos, (fb.v.i - fa.v.i + 32) % 32 AS mid FROM pts p JOIN fa USING (vec_id) JOIN fb USING (vec_id)),
ring AS MATERIALIZED (SELECT vec_id, pos, x, y, i FROM turn UNION ALL SELECT vec_id, 32, x, y, i FROM turn WHERE pos = 0),
seg AS (SELECT DISTINCT vec_id, CAST(tolerance AS DOUBLE) AS tolerance, CASE h WHEN 0 THEN 0 ELSE mid END AS s, CASE h WHEN 0 THEN mid ELSE 32 END AS e FROM turn, (VALUES {', '.join(f'({t})' for t in _SHARES)}) t(tolerance), (VALUES (0), (1)) u(h)
  UNION ALL SELECT f.vec_id, f.tolerance, CASE h WHEN 0 THEN f.s ELSE f.cut END, CASE h WHEN 0 THEN f.cut ELSE f.e END
  FROM (SELECT g.vec_id, g.tolerance, g.s, g.e, arg_min(p.pos, [-abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)), p.pos]) AS cut, max(abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) / sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS far, any_value(total) AS total
    FROM seg g JOIN ring a ON a.vec_id = g.vec_id AND a.pos = g.s JOIN ring b ON b.vec_id = g.vec_id AND b.pos = g.e JOIN ring p ON p.vec_id = g.vec_id AND p.pos > g.s AND p.pos < g.e JOIN len ON len.vec_id = g.vec_id GROUP BY ALL) f, (VALUES (0), (1)) u(h)
  WHERE f.far > f.tolerance * f.total),
kept AS (SELECT DISTINCT g.vec_id, g.tolerance, r.i FROM seg g JOIN ring r ON r.vec_id = g.vec_id AND r.pos = g.s)
SELECT vec_id, tolerance, count(*) AS corners, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS kept FROM kept GROUP BY 1, 2""")
def simplified_outlines(spark, d):
    """Outlines of points reduced to the corners that a tolerance leaves."""
    out = O.simplified(_points(spark, d), ["vec_id"], _SHARES)
    return rounded(out.select("vec_id", "tolerance", F.size("corners").alias("corners"), F.array_join(F.transform("corners", lambda c: c["i"].cast("string")), ",").alias("kept")))


# ---- points


#: Best first, each against those taken so far.
@query(f"""WITH RECURSIVE {_POINTS}, ranked AS MATERIALIZED (SELECT vec_id, i, x, y, row_number() OVER (PARTITION BY vec_id ORDER BY floor(abs(x) / 50) DESC, i) AS k FROM pts),
walk AS (SELECT vec_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[]) AS taken FROM (SELECT DISTINCT vec_id FROM pts)
  UNION ALL SELECT w.vec_id, r.k, CASE WHEN len(list_filter(w.taken, lambda t: (t.x - r.x) * (t.x - r.x) + (t.y - r.y) * (t.y - r.y) < 90.0 * 90.0)) = 0 THEN list_append(w.taken, {{'i': r.i, 'x': r.x, 'y': r.y}}) ELSE w.taken END
  FROM walk w JOIN ranked r ON r.vec_id = w.vec_id AND r.k = w.k + 1),
done AS (SELECT vec_id, unnest(taken) AS t, generate_subscripts(taken, 1) AS rank FROM walk WHERE k = 32)
SELECT vec_id, t.i AS i, rank FROM done WHERE rank <= 9""")
def spaced_points(spark, d):
    """The best points of each set that keep their distance, nine at most."""
    points = _points(spark, d).withColumn("quality", F.floor(F.abs("x") / 50))
    return rounded(spaced(points, ["vec_id"], "quality", "i", 90.0, 9).select("vec_id", "i", "rank"))


def _side(a: str, b: str) -> str:
    return f"(o.{b}_x - o.{a}_x) * (p.y - o.{a}_y) - (o.{b}_y - o.{a}_y) * (p.x - o.{a}_x)"


_TURNS = [_side(a, b) for a, b in (("tl", "tr"), ("tr", "br"), ("br", "bl"), ("bl", "tl"))]


@query(f"""WITH {_POINTS}, {_ORDERED} SELECT p.vec_id % 50 AS frame, p.vec_id AS point_of, p.i, o.vec_id AS quad_of, o.q FROM pts p JOIN ordered o ON o.vec_id % 50 = p.vec_id % 50
  WHERE ({" AND ".join(f"{t} >= 0" for t in _TURNS)}) OR ({" AND ".join(f"{t} <= 0" for t in _TURNS)})""")
def points_in_quads(spark, d):
    """Which quadrilaterals of a frame hold which of its points."""
    points = _points(spark, d).select((F.col("vec_id") % 50).alias("frame"), F.col("vec_id").alias("point_of"), "i", "x", "y")
    quads = _quads(spark, d).select((F.col("vec_id") % 50).alias("frame"), F.col("vec_id").alias("quad_of"), "q", "quad")
    return C.points_in_quads(points, quads, ["frame"]).select("frame", "point_of", "i", "quad_of", "q")


# ---- transforms

#: A known transform for each set of points; every fourth match is an outlier.
_KNOWN = ["1 + vec_id % 7 / 5e1", "vec_id % 5 / 4e1", "vec_id % 11 * 3e0", "vec_id % 3 / -3e1", "1 - vec_id % 4 / 6e1", "vec_id % 13 * -2e0", "vec_id % 6 / 5e4", "vec_id % 9 / -6e4", "1e0"]
_CANVAS = [(0, 0), (199, 0), (199, 149), (0, 149)]


def _projected(h: list[str], x: str, y: str) -> tuple[str, str]:
    w = f"(({h[6]}) * {x} + ({h[7]}) * {y} + ({h[8]}))"
    return f"(({h[0]}) * {x} + ({h[1]}) * {y} + ({h[2]})) / {w}", f"(({h[3]}) * {x} + ({h[4]}) * {y} + ({h[5]})) / {w}"


_EXPECTED = ", ".join(f"round({e}, 4) + 0.0 AS {a}{k}" for k, (x, y) in enumerate(_CANVAS) for a, e in zip("xy", _projected([f"k{i}" for i in range(9)], f"{x}.0", f"{y}.0"), strict=True))


@query(f"WITH k AS (SELECT DISTINCT vec_id, {', '.join(f'CAST({e} AS DOUBLE) AS k{i}' for i, e in enumerate(_KNOWN))} FROM embeddings) SELECT vec_id, 32 AS matches, 24 AS inliers, {_EXPECTED} FROM k")
def robust_homographies(spark, d):
    """Known transforms recovered from matches a quarter of which are wrong."""
    u, v = _projected(_KNOWN, "x", "y")
    wrong = F.when(F.col("i") % 4 == 3, 1).otherwise(0)
    p = _points(spark, d).select("vec_id", F.col("i").alias("index"), F.col("x").alias("sx"), F.col("y").alias("sy"), (F.expr(u) + wrong * (140 + 31 * F.col("i"))).alias("tx"), (F.expr(v) - wrong * (90 + F.col("i") * (F.col("vec_id") % 7) * 17)).alias("ty"))
    found = fitted_homographies(p, ["vec_id"])
    corners = G.project(F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in _CANVAS]), F.col("transform"))
    found = found.withColumn("c", once(corners))
    return found.select("vec_id", "matches", "inliers", *[(F.round(F.col("c")[k][a], 4) + F.lit(0.0)).alias(f"{a}{k}") for k in range(4) for a in "xy"])
