"""Homographies and similarities from correspondences with outliers, as one plan.

Seeded samples of four matches (two for a similarity) are rows; each gives an
exact transform in closed form. Transforms and matches meet on their key, and what
a transform explains is summed before the shuffle. The best one's inliers are
fitted by least squares: the normal equations are sums, and elimination over an
array solves them (a similarity's solution is a ratio of covariances). Nothing runs
in Python, and no task holds a set of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import written
from .hulls import bound

#: A multiplicative generator's modulus and factors.
_M, _A, _B, _C = 2147483647, 48271, 16807, 69621


def _draws(n: Column, number: Column, seed: int, size: int = 4) -> Column:
    """`size` different whole numbers below n, by the sample's number."""
    drawn = [F.pmod(F.pmod((number + 1) * _A + F.lit(k * _B + seed * _C), F.lit(_M)) * _A, F.lit(_M)) % (n - k) for k in range(size)]
    out = F.array(drawn[0].cast("long"))
    for d in drawn[1:]:  # counted past those there are
        out = F.concat(out, F.array(F.aggregate(F.array_sort(out), d.cast("long"), lambda v, p: v + (v >= p).cast("long"))))
    return out


def solve(rows: Column) -> Column:
    """The solution of n equations, an array of n arrays of n + 1 numbers whose
    leading minors aren't zero (as of normal equations of full rank); null entries
    otherwise."""

    def step(m, k):
        pivot = F.transform(m[k], lambda v: F.try_divide(v, m[k][k]))
        return bound(pivot, lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda a, b: a - row[k] * b))))

    done = F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), rows, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


_ENTRIES = [f"__h{k}" for k in range(9)]


def _entered(df: DataFrame, key: list[str], transform: str) -> DataFrame:
    """key and the transform's entries as columns, which compiled code reads."""
    return df.select(*key, *[F.col(transform)[k].alias(c) for k, c in enumerate(_ENTRIES)])


def _error() -> Column:
    """Distance of a match's target from its projected source."""
    h = [F.col(c) for c in _ENTRIES]
    w = h[6] * F.col("sx") + h[7] * F.col("sy") + h[8]
    u, v = F.try_divide(h[0] * F.col("sx") + h[1] * F.col("sy") + h[2], w), F.try_divide(h[3] * F.col("sx") + h[4] * F.col("sy") + h[5], w)
    return F.hypot(u - F.col("tx"), v - F.col("ty"))


def _fit(inliers: DataFrame, key: list[str]) -> DataFrame:
    """(*key, transform) by least squares over rows sx, sy, tx, ty, in
    coordinates shifted to their means and scaled by their spread."""
    places = ("sx", "sy", "tx", "ty")
    scale = inliers.groupBy(*key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in places],
        *[F.greatest(F.sqrt((F.var_pop(f"{s}x") + F.var_pop(f"{s}y")) / 2), F.lit(1e-12)).alias(f"d_{s}") for s in "st"],
    )
    rows = inliers.join(scale.hint("merge"), key)
    rows = rows.withColumns({f"__{c}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c[0]}") for c in places})
    x, y, u, v = (F.col(f"__{c}") for c in places)
    zero, one = F.lit(0.0), F.lit(1.0)
    two = ([x, y, one, zero, zero, zero, -u * x, -u * y, u], [zero, zero, zero, x, y, one, -v * x, -v * y, v])
    sums = [F.sum(two[0][i] * two[0][j] + two[1][i] * two[1][j]).alias(f"s{i}{j}") for i in range(8) for j in range(i, 9)]
    held = ["m_sx", "m_sy", "m_tx", "m_ty", "d_s", "d_t"]
    normal = rows.groupBy(*key).agg(*sums, *[F.first(c).alias(c) for c in held])
    entry = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}") if j < 8 else F.col(f"s{i}8")
    solved = normal.select(*key, *held, solve(F.array(*[F.array(*[entry(i, j) for j in range(9)]) for i in range(8)])).alias("__h"))
    h = [F.col("__h")[k] for k in range(8)] + [one]
    # back: scale and shift of the target, the solution, shift and scale of the source
    right = [c for r in range(3) for c in (h[3 * r] / F.col("d_s"), h[3 * r + 1] / F.col("d_s"), h[3 * r + 2] - (h[3 * r] * F.col("m_sx") + h[3 * r + 1] * F.col("m_sy")) / F.col("d_s"))]
    named = solved.withColumns({f"__r{k}": c for k, c in enumerate(right)})
    r = [F.col(f"__r{k}") for k in range(9)]
    full = [F.col("d_t") * r[k] + F.col("m_tx") * r[6 + k] for k in range(3)] + [F.col("d_t") * r[3 + k] + F.col("m_ty") * r[6 + k] for k in range(3)] + r[6:]
    return named.select(*key, F.array(*[F.try_divide(c, r[8]) for c in full]).alias("transform"))


def _fit_similarity(inliers: DataFrame, key: list[str]) -> DataFrame:
    """(*key, transform): the similarity of least squares over rows sx, sy, tx,
    ty; null without any extent."""
    named = ("sx", "sy", "tx", "ty")
    sums = inliers.groupBy(*key).agg(
        *[F.avg(c).alias(f"m_{c}") for c in named], (F.var_pop("sx") + F.var_pop("sy")).alias("d"),
        (F.covar_pop("sx", "tx") + F.covar_pop("sy", "ty")).alias("c"), (F.covar_pop("sx", "ty") - F.covar_pop("sy", "tx")).alias("s"),
    )
    turned = sums.withColumns({"a": F.try_divide("c", "d"), "b": F.try_divide("s", "d")})
    tx = F.col("m_tx") - F.col("a") * F.col("m_sx") + F.col("b") * F.col("m_sy")
    ty = F.col("m_ty") - F.col("b") * F.col("m_sx") - F.col("a") * F.col("m_sy")
    zero = F.lit(0.0)
    return turned.select(*key, F.array(F.col("a"), -F.col("b"), tx, F.col("b"), F.col("a"), ty, zero, zero, F.lit(1.0)).alias("transform"))


def _two(taken: DataFrame) -> DataFrame:
    """taken with h, the similarity of its two matches p; null entries where they
    start in one place."""
    p = F.col("p")
    dx, dy, du, dv = (p[1][c] - p[0][c] for c in ("sx", "sy", "tx", "ty"))
    far = dx * dx + dy * dy

    def moved(a, b):
        zero = F.lit(0.0)
        return F.array(a, -b, p[0]["tx"] - a * p[0]["sx"] + b * p[0]["sy"], b, a, p[0]["ty"] - b * p[0]["sx"] - a * p[0]["sy"], zero, zero, F.lit(1.0))

    return taken.withColumn("h", G.let([F.try_divide(dx * du + dy * dv, far), F.try_divide(dx * dv - dy * du, far)], moved))


def _four(taken: DataFrame) -> DataFrame:
    """taken with h, the homography of its four matches p."""
    quad = lambda a, b: [G.point(F.col("p")[i][a], F.col("p")[i][b]) for i in range(4)]
    return G.with_homography(taken, quad("sx", "sy"), quad("tx", "ty"), "h")


def robust_similarities(matches: DataFrame, key: list[str], samples: int = 64, threshold: float = 2.0, seed: int = 0) -> DataFrame:
    """robust_homographies() for turns, one scale and shifts, from samples of two."""
    return _robust(matches, key, samples, threshold, seed, 2, _two, _fit_similarity)


def robust_homographies(matches: DataFrame, key: list[str], samples: int = 64, threshold: float = 3.0, seed: int = 0) -> DataFrame:
    """(*key, matches, inliers, inlier_ratio, median_error, transform) of
    matches(*key, index, sx, sy, tx, ty), whose index counts from 0 without gaps.
    Of the samples the one with most matches within the threshold counts, of equals
    the one of least error, then of least number; its inliers are fitted, and
    counted again under the fitted transform. A key with fewer than four matches,
    or whose samples have no transform, has a null one and no inliers."""
    return _robust(matches, key, samples, threshold, seed, 4, _four, _fit)


def _robust(matches: DataFrame, key: list[str], samples: int, threshold: float, seed: int, size: int, model, fit) -> DataFrame:
    matches = matches.hint("merge")  # matches and samples are too many for a broadcast, whatever their file's size
    counts = matches.groupBy(*key).agg(F.count("*").alias("matches"))
    numbers = counts.filter(F.col("matches") >= size).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    drawn = numbers.select(*key, "sample", F.posexplode(_draws(F.col("matches"), F.col("sample"), seed, size)).alias("k", "index"))
    taken = drawn.join(matches, [*key, "index"]).groupBy(*key, "sample").agg(F.array_sort(F.collect_list(F.struct("k", "sx", "sy", "tx", "ty"))).alias("p"))
    # a generator's output, so that the filter and the entries don't work it out again
    models = model(taken).select(*key, "sample", F.explode(F.array("h")).alias("h"))
    models = written(_entered(models.filter(F.forall("h", lambda v: v.isNotNull() & ~F.isnan(v))), [*key, "sample"], "h"), "homographies")
    scored = matches.join(models, key).select(*key, "sample", _error().alias("e")).filter(F.col("e") <= threshold)
    score = scored.groupBy(*key, "sample").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    best = score.groupBy(*key).agg(F.min_by("sample", F.struct(-F.col("n"), "e", "sample")).alias("sample"))
    chosen = models.join(best, [*key, "sample"]).drop("sample")
    inliers = matches.join(chosen.hint("merge"), key).filter(_error() <= threshold).select(*matches.columns)
    fitted = written(fit(inliers, key), "homographies")
    errors = matches.join(_entered(fitted, key, "transform"), key).withColumn("e", _error()).filter(F.col("e") <= threshold)
    told = errors.groupBy(*key).agg(F.count("*").alias("inliers"), F.percentile("e", F.lit(0.5)).alias("median_error"))
    out = counts.join(fitted, key, "left").join(told, key, "left")
    inliers = F.coalesce("inliers", F.lit(0))
    return out.select(*key, "matches", inliers.alias("inliers"), (inliers / F.greatest(F.lit(1), "matches")).alias("inlier_ratio"), "median_error", "transform")
