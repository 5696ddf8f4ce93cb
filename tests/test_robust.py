"""Homographies with planted outliers against what was planted."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import robust as R


def project(h, x, y):
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def test_planted_transforms_come_back(spark):
    rng = random.Random(12)
    rows, known, good = [], {}, {}
    for g in range(12):
        h = [1 + rng.uniform(-0.2, 0.2), rng.uniform(-0.1, 0.1), rng.uniform(-50, 50), rng.uniform(-0.1, 0.1), 1 + rng.uniform(-0.2, 0.2), rng.uniform(-50, 50), rng.uniform(-1e-4, 1e-4), rng.uniform(-1e-4, 1e-4), 1.0]
        known[g], good[g] = h, 0
        for i in range(80):
            x, y = rng.uniform(0, 1920), rng.uniform(0, 1080)
            u, v = project(h, x, y)
            wrong = rng.random() < 0.4
            good[g] += not wrong
            u, v = (u + rng.choice([-1, 1]) * rng.uniform(60, 900), v + rng.uniform(-900, 900)) if wrong else (u + rng.gauss(0, 0.2), v + rng.gauss(0, 0.2))
            rows.append((g, i, x, y, u, v))
    rows += [(20, i, float(i), 1.0, float(i), 1.0) for i in range(3)] + [(21, i, 5.0, 5.0, 7.0, 7.0) for i in range(6)]
    matches = spark.createDataFrame(rows, "g long, index long, sx double, sy double, tx double, ty double")
    got = {r.g: r for r in R.robust_homographies(matches, ["g"], 128).collect()}
    for g, h in known.items():
        r = got[g]
        assert r.inliers == good[g] and r.matches == 80 and math.isclose(r.inlier_ratio, good[g] / 80) and r.median_error < 0.5
        for x, y in ((0, 0), (1919, 0), (1919, 1079), (0, 1079)):
            assert math.dist(project(h, x, y), project(r.transform, x, y)) < 1.5
        # the fit is the least-squares solution over its inliers
        own = [m[2:] for m in rows if m[0] == g and math.dist(project(r.transform, *m[2:4]), m[4:]) <= 3]
        (sx, sy, tx, ty), one = np.array(own).T, np.ones(len(own))
        t = [np.array([[1 / d, 0, -mx / d], [0, 1 / d, -my / d], [0, 0, 1]]) for mx, my, d in ((a.mean(), b.mean(), math.sqrt((a.var() + b.var()) / 2)) for a, b in ((sx, sy), (tx, ty)))]
        (x, y, _), (u, v, _) = (m @ np.array([a, b, one]) for m, a, b in zip(t, (sx, tx), (sy, ty), strict=True))
        z = np.zeros_like(x)
        a = np.vstack([np.array([x, y, one, z, z, z, -u * x, -u * y]).T, np.array([z, z, z, x, y, one, -v * x, -v * y]).T])
        fit = np.append(np.linalg.lstsq(a, np.concatenate([u, v]), rcond=None)[0], 1).reshape(3, 3)
        fit = np.linalg.inv(t[1]) @ fit @ t[0]
        assert np.allclose(np.array(r.transform), (fit / fit[2, 2]).ravel(), rtol=1e-6, atol=1e-9)
    for g in (20, 21):
        assert got[g].transform is None and got[g].inliers == 0


def test_planted_similarities_come_back(spark):
    rng = random.Random(5)
    rows, good = [], {}
    for g in range(10):
        a, b, tx, ty, good[g] = 1 + rng.uniform(-0.3, 0.3), rng.uniform(-0.4, 0.4), rng.uniform(-90, 90), rng.uniform(-90, 90), 0
        for i in range(50):
            x, y = rng.uniform(0, 900), rng.uniform(0, 600)
            u, v = a * x - b * y + tx + rng.gauss(0, 0.2), b * x + a * y + ty + rng.gauss(0, 0.2)
            wrong = rng.random() < 0.4
            good[g] += not wrong
            rows.append((g, i, x, y, u + wrong * rng.uniform(50, 500), v - wrong * rng.uniform(50, 500)))
    rows += [(20, 0, 1.0, 1.0, 2.0, 2.0), (21, 0, 3.0, 3.0, 1.0, 1.0), (21, 1, 3.0, 3.0, 2.0, 2.0)]
    matches = spark.createDataFrame(rows, "g long, index long, sx double, sy double, tx double, ty double")
    for r in R.robust_similarities(matches, ["g"]).collect():
        if r.g >= 20:
            assert r.transform is None and r.inliers == 0
            continue
        assert r.inliers == good[r.g]
        own = np.array([m[2:] for m in rows if m[0] == r.g and math.dist(project(r.transform, *m[2:4]), m[4:]) <= 2])
        x, y, u, v = own.T
        z, one = np.zeros_like(x), np.ones_like(x)
        fit = np.linalg.lstsq(np.vstack([np.array([x, -y, one, z]).T, np.array([y, x, z, one]).T]), np.concatenate([u, v]), rcond=None)[0]
        assert np.allclose([r.transform[k] for k in (0, 3, 2, 5)], fit)


def test_samples_are_different_numbers(spark):
    df = spark.range(2000).select((F.col("id") % 50 + 4).alias("n"), R._draws(F.col("id") % 50 + 4, F.col("id"), 3).alias("d"))
    seen = set()
    for r in df.collect():
        assert len(set(r.d)) == 4 and min(r.d) >= 0 and max(r.d) < r.n
        seen.add(tuple(r.d))
    assert len(seen) > 1500


def test_elimination(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    a, b = a @ a.T + np.eye(5), rng.normal(size=5)
    rows = [[float(v) for v in r] for r in np.c_[a, b]]
    got = spark.createDataFrame([(rows,), ([[0.0, 1.0], ],)], "m array<array<double>>").select(R.solve(F.col("m")).alias("x")).collect()
    assert np.allclose(got[0].x, np.linalg.solve(a, b)) and got[1].x == [None]


def test_small_files_of_many_rows_are_not_broadcast(spark):
    from cadenza.sources.scratch import written

    samples = written(spark.range(50).selectExpr("id as k", "id % 3 as v"), "samples")
    joined = spark.range(50).selectExpr("id as k").join(samples.filter("v > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60)))), "k")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 33 * 60


def test_staged_homography_is_the_expression(spark):
    from cadenza.functions import geometry as G

    rng = random.Random(3)
    rows = [([(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(4)], [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(4)]) for _ in range(20)]
    rows.append(([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], rows[0][1]))
    df = spark.createDataFrame(rows, "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    both = G.with_homography(df.withColumn("want", G.homography(F.col("a"), F.col("b"))), F.col("a"), F.col("b"), "got")
    assert set(both.columns) == {"a", "b", "want", "got"} and all(r.want == r.got for r in both.collect())
