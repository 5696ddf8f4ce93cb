"""Summaries, weighted medians, coverages and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import project
from .gates import finite, ratio


def summary_columns(metrics: dict[str, Column], ok: Column, prefix: str = "") -> list[Column]:
    """pairs, ok_pairs and mean, p95, max of each metric over accepted rows with
    a finite value; null if there are none."""
    out = [F.count(F.lit(1)).alias(f"{prefix}pairs"), F.count_if(ok).alias(f"{prefix}ok_pairs")]
    for name, value in metrics.items():
        used = F.when(ok & finite(value), value)
        out += [F.avg(used).alias(f"{prefix}{name}_mean"), F.percentile(used, F.lit(0.95)).alias(f"{prefix}{name}_p95"), F.max(used).alias(f"{prefix}{name}_max")]
    return out


def summarize(df: DataFrame, key: str, metrics: dict[str, Column], ok: Column) -> DataFrame:
    return df.groupBy(key).agg(*summary_columns(metrics, ok))


def summarize_with_tail(df: DataFrame, key: str, metrics: dict[str, Column], ok: Column, in_tail: Column) -> DataFrame:
    """Whole series and tail in one pass: the tail's columns are prefixed."""
    tail = []
    for c in summary_columns({n: F.when(in_tail, v) for n, v in metrics.items()}, ok & in_tail, "last_"):
        tail.append(c)
    tail[0] = F.count_if(in_tail).alias("last_pairs")
    return df.groupBy(key).agg(*summary_columns(metrics, ok), *tail)


def learned_summary(df: DataFrame, key: str, metrics: dict[str, Column], accepted: Column) -> DataFrame:
    """n, accepted, accept_ratio, and median, p05, p95 of finite values over all
    rows, accepted or not."""
    out = [F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("accepted")]
    for name, value in metrics.items():
        three = F.percentile(F.when(finite(value), value), F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)))
        out.append(three.alias(f"__{name}"))
    found = df.groupBy(key).agg(*out).withColumn("accept_ratio", ratio(F.col("accepted"), F.col("n")))
    for name in metrics:
        found = found.withColumns({f"{name}_{p}": F.col(f"__{name}")[i] for i, p in enumerate(("median", "p05", "p95"))}).drop(f"__{name}")
    return found


def reason_histogram(df: DataFrame, key: str, reason: str) -> DataFrame:
    return df.groupBy(key, reason).agg(F.count(F.lit(1)).alias("n"))


def reason_map(df: DataFrame, key: str, reason: str) -> DataFrame:
    """(key, reasons map<string, long>)."""
    counted = reason_histogram(df, key, reason)
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("reasons"))


def weighted_median(df: DataFrame, key: list[str], value: str, weight: str, name: str = "weighted_median") -> DataFrame:
    """Lower weighted median: the least value at which the running weight
    reaches half. Equal values are one step, summed before the window, so a
    group needs as much memory as it has distinct values."""
    steps = df.groupBy(*key, value).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*key)
    run = steps.withColumns({"__run": F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__w").over(w)})
    return run.filter(F.col("__run") >= F.col("__all") / 2).groupBy(*key).agg(F.min(value).alias(name))


def dominant_direction(df: DataFrame, key: list[str], angle: str, length: str, cluster: float = 0.35, least_segments: int = 2, least_length: float = 1000.0, most_angle: float | None = None) -> DataFrame:
    """Consensus of weighted line candidates: their weighted median angle, the
    candidates within `cluster` degrees of it, and the weighted median of those
    if they are enough and long enough. Equal angles are one step, and all else is
    windows over the steps: one pass over the candidates, one exchange by key."""
    steps = df.dropna(subset=key).groupBy(*key, angle).agg(F.count(F.lit(1)).alias("__n"), F.sum(length).alias("__w"))
    by = Window.partitionBy(*key)
    so_far = by.orderBy(angle).rowsBetween(Window.unboundedPreceding, 0)

    def reached(weight: Column) -> tuple[Column, Column]:
        return F.sum(weight).over(so_far), F.sum(weight).over(by)

    run, whole = reached(F.col("__w"))
    steps = steps.withColumns({"__run": run, "__all": whole})
    steps = steps.withColumn("dominant_angle", F.min(F.when(F.col("__run") >= F.col("__all") / 2, F.col(angle))).over(by)).filter("dominant_angle is not null")
    steps = steps.withColumn("__in", F.abs(F.col(angle) - F.col("dominant_angle")) <= cluster)
    run, whole = reached(F.when(F.col("__in"), F.col("__w")))
    steps = steps.withColumns({"__run": run, "__all": whole})
    found = steps.groupBy(*key, "dominant_angle").agg(
        F.sum("__n").alias("candidates"), F.sum(F.when(F.col("__in"), F.col("__n")).otherwise(0)).alias("inliers"), F.sum(F.when(F.col("__in"), F.col("__w")).otherwise(0.0)).alias("inlier_length"),
        F.min(F.when(F.col("__in") & (F.col("__run") >= F.col("__all") / 2), F.col(angle))).alias("cluster_angle"),
    )
    ok = (F.col("inliers") >= least_segments) & (F.col("inlier_length") >= least_length)
    if most_angle is not None:
        ok = ok & (F.abs("cluster_angle") <= most_angle)
    found = found.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    return found.withColumn("accepted_angle", F.when(F.col("accepted"), F.col("cluster_angle"))).drop("cluster_angle")


def coverage(value: Column) -> Column:
    """p95 - p05 of a coordinate over a group, at least 0; under two points 0."""
    both = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return F.when(F.count(value) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), both[1] - both[0]))


def coverage_of_width(value: Column, width: Column) -> Column:
    """Pixels first, then the share of max(1, width)."""
    return coverage(value) / F.greatest(F.lit(1), width)


def coverage_normalised(value: Column, width: Column) -> Column:
    """Coordinates over width - 1 first."""
    return coverage(value / (width - 1))


def median_reprojection(error: Column) -> Column:
    """Median error over a group, infinite for none."""
    return F.coalesce(F.percentile(error, F.lit(0.5)), F.lit(float("inf")))


def unit_coverage(points: Column, h: Column) -> tuple[Column, Column]:
    """Coverage of points seen through a transform to the unit square; the
    points of a row are an array."""
    at = project(points, h)

    def spread(axis: str) -> Column:
        v = F.array_sort(F.transform(at, lambda p: p[axis]))
        n = F.size(v)

        def quantile(q: float) -> Column:
            place = F.lit(q) * (n - 1)
            low = F.floor(place).cast("int")
            a, b = F.element_at(v, low + 1), F.element_at(v, F.least(low + 2, n))
            return a + (b - a) * (place - low)

        return F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), quantile(0.95) - quantile(0.05)))

    return spread("x"), spread("y")


def background_level(gray: Column, masked: Column, white: float, share: float) -> Column:
    """The lesser of the white threshold and a percentile of the masked gray
    values of a group; the threshold if nothing is masked."""
    return F.least(F.lit(white), F.coalesce(F.percentile(F.when(masked, gray), F.lit(share)), F.lit(white)))


def best_by(value: str, *order: str) -> Column:
    """The value of a group's greatest row by several columns."""
    return F.max_by(value, F.struct(*order))


def angle_summary(df: DataFrame, key: list[str], angle: str) -> DataFrame:
    """Mean, population deviation and p95 of the absolute angle. Equal absolute
    values are counted before they meet, so a group costs its distinct values."""
    plain = df.groupBy(*key).agg(F.avg(angle).alias("mean"), F.stddev_pop(angle).alias("std"))
    counted = df.filter(F.col(angle).isNotNull()).groupBy(*key, F.abs(angle).alias("__a")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key)
    run = counted.withColumns({"__to": F.sum("__n").over(w.orderBy("__a").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(w)})
    place = 0.95 * (F.col("__all") - 1)
    low, high = F.floor(place), F.ceil(place)
    at = lambda k: F.min(F.when(F.col("__to") > k, F.col("__a")))
    found = run.groupBy(*key).agg(at(low).alias("__low"), at(high).alias("__high"), F.max(place - low).alias("__t"))
    p95 = F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__t")
    return plain.join(found, key, "left").select(*key, "mean", "std", p95.alias("p95_abs"))


def improvement_ratio(df: DataFrame, key: list[str], method: str, value: str, base: str, other: str) -> DataFrame:
    """value of method `base` over that of `other`."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return df.groupBy(*key).agg(F.try_divide(pick(base), pick(other)).alias("improvement"))


def method_pivot(df: DataFrame, key: list[str], method: str, value: str, methods: list[str]) -> DataFrame:
    return df.groupBy(*key).pivot(method, methods).agg(F.max(value))


def lsq_similarity(df: DataFrame, key: list[str], x: str, y: str, u: str, v: str) -> DataFrame:
    """Least-squares similarity (x, y) -> (u, v): a, b, tx, ty with
    u = a x - b y + tx and v = b x + a y + ty, from sums alone."""
    c = F.col
    s = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s_{n}") for n in (x, y, u, v)],
        F.sum(c(x) * c(x) + c(y) * c(y)).alias("s_q"), F.sum(c(x) * c(u) + c(y) * c(v)).alias("s_p"), F.sum(c(x) * c(v) - c(y) * c(u)).alias("s_r"),
    )
    q = c("s_q") - (c(f"s_{x}") * c(f"s_{x}") + c(f"s_{y}") * c(f"s_{y}")) / c("n")
    p = c("s_p") - (c(f"s_{x}") * c(f"s_{u}") + c(f"s_{y}") * c(f"s_{v}")) / c("n")
    r = c("s_r") - (c(f"s_{x}") * c(f"s_{v}") - c(f"s_{y}") * c(f"s_{u}")) / c("n")
    s = s.withColumns({"a": F.try_divide(p, q), "b": F.try_divide(r, q)})
    tx = (c(f"s_{u}") - c("a") * c(f"s_{x}") + c("b") * c(f"s_{y}")) / c("n")
    ty = (c(f"s_{v}") - c("b") * c(f"s_{x}") - c("a") * c(f"s_{y}")) / c("n")
    return s.select(*key, "n", "a", "b", tx.alias("tx"), ty.alias("ty"))
