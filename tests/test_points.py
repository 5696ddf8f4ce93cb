"""Spaced points and points in quadrilaterals against plain Python."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from cadenza.operators.containment import points_in_quads
from cadenza.operators.spacing import spaced_points
from cadenza.plans import catalogue


def greedy(points, distance, most):
    taken = []
    for o, _, x, y in sorted(points, key=lambda p: (-p[1], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= distance * distance for _, a, b in taken):
            taken.append((o, x, y))
    return [t[0] for t in taken[:most]]


def test_rounds_give_the_sequential_choice(spark):
    rng = random.Random(6)
    rows = []
    for g in range(6):
        for o in range(150):
            spread = rng.choice([3, 60])
            rows.append((g, o, float(rng.randint(0, 5)), round(rng.uniform(0, spread), 1), round(rng.uniform(0, spread), 1)))
    rows += [(6, o, 1.0, 0.0, 0.0) for o in range(40)] + [(7, 0, 1.0, 0.0, 0.0), (7, 1, 1.0, 8.0, 0.0), (7, 2, 5.0, 15.9, 0.0)]
    rows += [(8, o, float(-o), 5.0 * o, 0.0) for o in range(12)]  # each waits for the one before
    rows += [(None, o, 2.0, 3.0 * o, 1.0) for o in range(9)]
    bad = [(0, 900, 9.0, None, 1.0), (0, 901, 9.0, float("nan"), 1.0), (0, 902, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + bad, "g long, o long, q double, x double, y double")
    for most in (None, 7):
        got = {}
        for r in spaced_points(df, ["g"], "q", "o", 8.0, most).collect():
            got.setdefault(r.g, []).append((r.rank, r.o))
        for g in {r[0] for r in rows}:
            want = greedy([r[1:] for r in rows if r[0] == g], 8.0, most)
            assert [o for _, o in sorted(got[g])] == want
    assert spaced_points(df.filter(F.lit(False)), ["g"], "q", "o", 8.0).count() == 0


def test_points_in_quads_of_all_sizes(spark):
    rng = random.Random(4)

    def quad(cx, cy, w, h, turned):
        p = [(cx - w, cy - h), (cx + w, cy - h), (cx + w, cy + h), (cx - w, cy + h)]
        return p[::-1] if turned else p

    quads = [(k % 3, k, quad(rng.uniform(-50, 50), rng.uniform(-50, 50), *(10 ** rng.uniform(-2, 3) for _ in "wh"), k % 2)) for k in range(60)]
    quads += [(0, 90, [(5.0, 5.0)] * 4), (0, 91, [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (0.0, 0.0)])]
    points = [(k % 3, k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(300)] + [(0, 900, 5.0, 5.0), (0, 901, 5.0, 0.0), (0, 902, 20.0, 0.0)]
    q = spark.createDataFrame([(g, k, [{"x": float(x), "y": float(y)} for x, y in p]) for g, k, p in quads], "g long, k long, quad array<struct<x:double,y:double>>")
    p = spark.createDataFrame(points + [(0, 903, None, 1.0), (0, 904, float("nan"), 1.0)], "g long, i long, x double, y double")
    got = {(r.k, r.i) for r in points_in_quads(p, q, ["g"]).collect()}
    want = set()
    for g, k, c in quads:
        for h, i, x, y in points:
            if g == h and min(a for a, _ in c) <= x <= max(a for a, _ in c) and min(b for _, b in c) <= y <= max(b for _, b in c):
                want.add((k, i))
    assert got == want and (90, 900) in got and (91, 901) in got and (91, 902) not in got


def turned_quads(n):
    """Convex ones in any position, thin and wide, a third of them mirrored, on
    whole numbers: many edges and corners are on points or on cells' sides."""
    rng = random.Random(9)
    out = []
    while len(out) < n:
        p = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(4)]
        turns = [(p[(i + 1) % 4][0] - p[i][0]) * (p[(i + 2) % 4][1] - p[i][1]) - (p[(i + 1) % 4][1] - p[i][1]) * (p[(i + 2) % 4][0] - p[i][0]) for i in range(4)]
        if all(t > 0 for t in turns) or all(t < 0 for t in turns) and len(out) % 3 == 0:
            out.append([(float(x), float(y)) for x, y in p])
    return out


def tables(spark, quads, points):
    q = spark.createDataFrame([(k % 2, k, [{"x": x, "y": y} for x, y in p]) for k, p in enumerate(quads)], "g long, k long, quad array<struct<x:double,y:double>>")
    return spark.createDataFrame([(i % 2, i, x, y) for i, (x, y) in enumerate(points)], "g long, i long, x double, y double"), q


def test_points_in_turned_quads_and_on_their_edges(spark):
    rng = random.Random(2)
    quads = turned_quads(80) + [[(-32.0, -32.0), (32.0, 32.0), (32.0, 32.0), (-32.0, -32.0)], [(0.0, 0.0), (0.0, 0.0), (8.0, 0.0), (8.0, 8.0)]]
    points = [(float(rng.randint(-40, 40)), float(rng.randint(-40, 40))) for _ in range(1200)]
    p, q = tables(spark, quads, points)
    got = [(r.k, r.i) for r in points_in_quads(p, q, ["g"]).collect()]
    want = set()
    for k, c in enumerate(quads):
        for i, (x, y) in enumerate(points):
            t = [(c[(n + 1) % 4][0] - c[n][0]) * (y - c[n][1]) - (c[(n + 1) % 4][1] - c[n][1]) * (x - c[n][0]) for n in range(4)]
            boxed = min(a for a, _ in c) <= x <= max(a for a, _ in c) and min(b for _, b in c) <= y <= max(b for _, b in c)
            if k % 2 == i % 2 and boxed and (all(v >= 0 for v in t) or all(v <= 0 for v in t)):
                want.add((k, i))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_points_in_quads_join_is_compiled(spark, capsys):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    p, q = tables(spark, turned_quads(20), [(1.0, 1.0)])
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        points_in_quads(p, q, ["g"]).select("g", "i", "k").explain("codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_points_in_quads_tries_every_point(spark, tmp_path):
    """All 32 points of each vector, by the query and by its SQL."""
    rng = random.Random(12)
    square = [0.5 * s for s in (-1, -1, 1, -1, 1, 1, -1, 1)]
    vectors = {k: [rng.uniform(-0.4, 0.4) for _ in range(64)] for k in (0, 1, 50, 100)}
    vectors[0][:8] = square
    rows = [(k, v, 0) for k, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    order = ["frame", "point_of", "i", "quad_of", "q"]
    got = [tuple(r[c] for c in order) for r in catalogue.queries()["points_in_quads"](spark, str(tmp_path)).collect()]
    by_sql = duckdb.sql(f"SELECT {', '.join(order)} FROM ({catalogue.oracle_sql()['points_in_quads'].replace('FROM embeddings', f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")})").fetchall()
    assert len(got) == len(set(got)) and sorted(got) == sorted(by_sql)
    # The square holds all points of its frame, and of no other.
    assert {r[1:3] for r in got if r[3:] == (0, 0)} == {(k, i) for k in (0, 50, 100) for i in range(32)}
