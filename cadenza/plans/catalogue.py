"""Every registered query of the core engine and its SQL twin.

The engine's own tables are stood in for by the driver's: an event is a frame's
observation (user = series, time and id = order, value = measure, type 'error' =
rejected, props.k = weight), an embedding is eight quadrilaterals or 32 points,
a line item is a weighted line candidate or a row of quality counters.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import folds as D
from ..operators import gates as Q
from ..operators import joins as J
from ..operators import sampling as S
from ..operators.timeseries import Series, adjacent, centred_filter, smooth_corners, smooth_trajectory
from .trajectory import global_switch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

SERIES = Series("user_id", ["ts", "event_id"])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers to longs."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = r6(c.cast("double"))
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def once(c: Column) -> Column:
    """A generator's single row: later filters and projections use its value in
    place of a copy of the expression."""
    return F.explode(F.array(c))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment
    root = __file__.rsplit("/cadenza/", 1)[0]
    if root not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumns({"ok": F.col("event_type") != "error", "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})


_OBS = """obs AS (
  SELECT event_id, ts, user_id, event_type, value, props, event_type <> 'error' AS ok, epoch_us(ts) / 1e6 AS t,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# ---- summaries


def _metric_sql(name: str, value: str, ok: str, prefix: str = "") -> str:
    f = f"FILTER (WHERE {ok})"
    return f"{_r(f'avg({value}) {f}')} AS {prefix}{name}_mean, {_r(f'quantile_cont({value}, 0.95) {f}')} AS {prefix}{name}_p95, {_r(f'max({value}) {f}')} AS {prefix}{name}_max"


@query(f"""WITH {_OBS} SELECT user_id, count(*) AS pairs, count(*) FILTER (WHERE ok) AS ok_pairs,
  {_metric_sql("value", "value", "ok")}, {_metric_sql("delta", "abs(value - 50)", "ok")} FROM obs GROUP BY user_id""")
def stability_summary(spark, d):
    """Pairs, accepted pairs, and mean, p95 and maximum per series."""
    metrics = {"value": F.col("value"), "delta": F.abs(F.col("value") - 50)}
    return rounded(A.summarize(observations(spark, d), "user_id", metrics, F.col("ok")))


_TAIL = "t >= greatest(0.0, last_t - 604800.0)"


@query(f"""WITH {_OBS}, e AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last_t FROM obs)
SELECT user_id, count(*) AS pairs, count(*) FILTER (WHERE ok) AS ok_pairs, {_metric_sql("value", "value", "ok")},
  count(*) FILTER (WHERE {_TAIL}) AS last_pairs, count(*) FILTER (WHERE ok AND {_TAIL}) AS last_ok_pairs, {_metric_sql("value", "value", f"ok AND {_TAIL}", "last_")}
FROM e GROUP BY user_id""")
def last_n_seconds_summary(spark, d):
    """Whole series and its last week, in one pass."""
    e = observations(spark, d).withColumn("last_t", F.max("t").over(SERIES.whole))
    tail = Q.in_last_seconds(F.col("t"), F.col("last_t"), 604800.0)
    return rounded(A.summarize_with_tail(e, "user_id", {"value": F.col("value")}, F.col("ok"), tail))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH {_OBS} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ok) AS accepted, {_r("count(*) FILTER (WHERE ok) / greatest(1, count(*))")} AS accept_ratio,
  {_r("quantile_cont(value, 0.5)")} AS value_median, {_r("quantile_cont(value, 0.05)")} AS value_p05, {_r("quantile_cont(value, 0.95)")} AS value_p95,
  {_r(f"quantile_cont({_K}, 0.5)")} AS k_median, {_r(f"quantile_cont({_K}, 0.05)")} AS k_p05, {_r(f"quantile_cont({_K}, 0.95)")} AS k_p95 FROM obs GROUP BY user_id""")
def learned_summary(spark, d):
    """Median and outer percentiles over all rows, with the accept ratio."""
    e = observations(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return rounded(A.learned_summary(e, "user_id", {"value": F.col("value"), "k": F.col("k")}, F.col("ok")))


@query(f"""WITH {_OBS}, p AS (SELECT user_id, event_id, ok, t, value, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, {_r("t - pt")} AS dt, {_r("value - pv")} AS dv, {_r("sqrt((value - pv) * (value - pv) + 9.0)")} AS magnitude FROM p WHERE pt IS NOT NULL""")
def adjacent_motion(spark, d):
    """Each row's change against its predecessor."""
    e = adjacent(observations(spark, d), SERIES, ["t", "value"]).filter("previous_t is not null")
    dv = F.col("value") - F.col("previous_value")
    return rounded(e.select("user_id", "event_id", (F.col("t") - F.col("previous_t")).alias("dt"), dv.alias("dv"), F.hypot(dv, F.lit(3.0)).alias("magnitude")))


# ---- gates


def _counters(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber", (c("l_quantity") * 2).alias("points"), (c("l_quantity") * 3).alias("inliers"), (c("l_discount") * 10).alias("ratio"), (c("l_tax") * 40).alias("error"),
        (c("l_discount") * 8).alias("cov_x"), (c("l_tax") * 12).alias("cov_y"), (c("l_extendedprice") / 4000).alias("shift"), (c("l_discount") * 8 - 0.4).alias("turn"), (c("l_tax") / 4).alias("scale"),
    )


_COUNTERS = """c AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS points, l_quantity * 3 AS inliers, l_discount * 10 AS ratio, l_tax * 40 AS error,
  l_discount * 8 AS cov_x, l_tax * 12 AS cov_y, l_extendedprice / 4000 AS shift, l_discount * 8 - 0.4 AS turn, l_tax / 4 AS scale FROM lineitem)"""
_TRACKER_CASE = """CASE WHEN points < 20 THEN 'not_enough_mature_points' WHEN inliers < 40 THEN 'not_enough_inliers' WHEN ratio < 0.25 THEN 'low_inlier_ratio'
  WHEN error > 2.5 THEN 'high_reprojection_error' WHEN cov_x < 0.25 THEN 'low_coverage_x' WHEN cov_y < 0.2 THEN 'low_coverage_y' ELSE 'accepted' END"""
_ALIGN_CASE = """CASE WHEN inliers < 80 THEN 'too_few_inliers' WHEN ratio < 0.6 THEN 'low_inlier_ratio' WHEN cov_x < 0.25 THEN 'low_coverage_x' WHEN cov_y < 0.2 THEN 'low_coverage_y'
  WHEN error > 1.0 THEN 'high_reprojection_error' WHEN shift > 12.0 THEN 'large_translation' WHEN abs(turn) > 0.5 THEN 'large_rotation' WHEN abs(scale) > 0.01 THEN 'large_scale_delta' ELSE 'accepted' END"""


@query(f"WITH {_COUNTERS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_TRACKER_CASE} AS tracker, {_ALIGN_CASE} AS align, CASE WHEN inliers < 80 THEN 'too_few_inliers' WHEN ratio < 0.6 THEN 'low_inlier_ratio' WHEN cov_x < 0.25 THEN 'low_coverage_x' WHEN cov_y < 0.2 THEN 'low_coverage_y' ELSE 'accepted' END AS align_open, CASE WHEN points < 40 THEN 'not_enough_matches' WHEN inliers < 30 THEN 'not_enough_inliers' WHEN ratio < 0.25 THEN 'low_inlier_ratio' WHEN error > 4.0 THEN 'high_reprojection_error' WHEN cov_x < 0.2 THEN 'low_coverage_x' WHEN cov_y < 0.15 THEN 'low_coverage_y' ELSE 'ok' END AS learned, CASE WHEN points < 30 THEN 'not_enough_features' WHEN inliers < 30 THEN 'not_enough_tracked_points' ELSE 'ok' END AS pair FROM c")
def reject_reason_cascade(spark, d):
    """The cascades of tracker, alignment (all gates; optional ones off), learned
    probe and pair motion: the first failing gate's reason."""
    names = {"inliers": "inliers", "ratio": "ratio", "error": "error", "cov_x": "cov_x", "cov_y": "cov_y"}
    yes = F.lit(True)
    return rounded(
        _counters(spark, d).select(
            "l_orderkey",
            "l_linenumber",
            Q.TrackerGates().reason(mature="points", **names).alias("tracker"),
            Q.AlignGates().reason(**names, translation="shift", rotation="turn", scale_delta="scale").alias("align"),
            Q.AlignGates(reprojection_error=0, translation=0, rotation=0, scale_delta=0).reason(**names, translation="shift", rotation="turn", scale_delta="scale").alias("align_open"),
            Q.LearnedGates().reason(matches="points", **names).alias("learned"),
            Q.pair_reason(F.col("points"), yes, F.col("inliers"), yes).alias("pair"),
        )
    )


@query(f"WITH {_COUNTERS} SELECT reason, count(*) AS n FROM (SELECT {_TRACKER_CASE} AS reason FROM c) GROUP BY reason")
def reason_histogram(spark, d):
    reason = Q.TrackerGates().reason(mature="points", inliers="inliers", ratio="ratio", error="error", cov_x="cov_x", cov_y="cov_y")
    rows = _counters(spark, d).select(F.lit(0).alias("all"), reason.alias("reason"))
    return A.reason_histogram(rows, "all", "reason").select("reason", "n")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value <= greatest(3.0, 1.5 * 40.0)) AS kept, count(*) FILTER (WHERE value >= 10 AND value < 200 AND abs(value - 50) < 100) AS consistent FROM events GROUP BY event_type")
def point_filters(spark, d):
    """Kept after an accepted frame; forward-backward consistent."""
    e = read(spark, d, "events")
    value = F.col("value")
    consistent = Q.flow_consistent(value >= 10, value < 200, F.abs(value - 50), 100)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(Q.keep_after_accept(value, 40.0)).alias("kept"), F.count_if(consistent).alias("consistent"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity * 10 >= greatest(140, floor(1920 / 10)) AND abs(l_discount * 30 - 1) <= 1.0) AS kept FROM lineitem GROUP BY l_returnflag")
def line_candidate_filter(spark, d):
    li = read(spark, d, "lineitem")
    ok = Q.line_candidate_ok(F.col("l_quantity") * 10, F.col("l_discount") * 30 - 1, 1920, 1.0)
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("kept"))


@query(f"""WITH {_OBS}, g AS (SELECT user_id, event_id, ok, count(*) FILTER (WHERE ok) OVER (PARTITION BY user_id) / greatest(1, n) AS q FROM obs)
SELECT user_id, event_id, {_r("q")} AS global_accept_ratio, q >= 0.8 AS global_enabled FROM g""")
def accept_ratio_switch(spark, d):
    """The whole series' accept ratio switches each of its rows."""
    out = global_switch(observations(spark, d), "ok", 0.8, "user_id")
    return rounded(out.select("user_id", "event_id", "global_accept_ratio", "global_enabled"))


# ---- windows


@query(f"WITH {_OBS} SELECT user_id, event_id, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reference FROM obs")
def hold_last_accepted(spark, d):
    e = observations(spark, d)
    return e.select("user_id", "event_id", SERIES.hold(F.col("value"), F.col("ok")).alias("held"), SERIES.first(F.col("value")).alias("reference"))


@query(f"""WITH {_OBS}, k AS (SELECT *, last_value(CASE WHEN ok THEN i END IGNORE NULLS) OVER p AS li, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER p AS lv,
  first_value(CASE WHEN ok THEN i END IGNORE NULLS) OVER f AS hi, first_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER f AS hv FROM obs
  WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, {_r("CASE WHEN li IS NULL AND hi IS NULL THEN value WHEN li IS NULL THEN hv WHEN hi IS NULL THEN lv WHEN li = hi THEN lv ELSE lv + (hv - lv) * ((i - li) / (hi - li)) END")} AS interpolated FROM k""")
def gap_interpolation(spark, d):
    e = observations(spark, d).withColumn("i", SERIES.index())
    return rounded(e.select("user_id", "event_id", SERIES.interpolate(F.col("value"), F.col("ok"), F.col("i")).alias("interpolated")))


def _padded(source: str, r: int, agg: str) -> str:
    return f"""SELECT a.user_id, a.event_id, a.i, a.n, CASE WHEN a.n < 3 THEN any_value(a.v) ELSE {agg}(b.v) END AS v FROM {source} a CROSS JOIN range(-{r}, {r} + 1) k(o)
  JOIN {source} b ON b.user_id = a.user_id AND b.i = greatest(0, least(a.n - 1, a.i + k.o)) GROUP BY a.user_id, a.event_id, a.i, a.n"""


@query(f"WITH {_OBS}, s AS (SELECT user_id, event_id, i, n, value AS v FROM obs) SELECT user_id, event_id, v AS smoothed FROM ({_padded('s', 2, 'median')})")
def edge_padded_median(spark, d):
    out = centred_filter(observations(spark, d), SERIES, ["value"], 5, "median")
    return out.select("user_id", "event_id", F.col("value").alias("smoothed"))


@query(f"WITH {_OBS}, s AS (SELECT user_id, event_id, i, n, value AS v FROM obs) SELECT user_id, event_id, {_r('v')} AS smoothed FROM ({_padded('s', 3, 'avg')})")
def edge_padded_mean(spark, d):
    out = centred_filter(observations(spark, d), SERIES, ["value"], 7, "mean")
    return rounded(out.select("user_id", "event_id", F.col("value").alias("smoothed")))


@query(f"WITH {_OBS}, s AS (SELECT user_id, event_id, i, n, value AS v FROM obs), m AS MATERIALIZED ({_padded('s', 2, 'median')}) SELECT user_id, event_id, {_r('v')} AS smoothed FROM ({_padded('m', 15, 'avg')})")
def median_then_mean(spark, d):
    out = smooth_trajectory(observations(spark, d), SERIES, ["value"], 5, 31)
    return rounded(out.select("user_id", "event_id", F.col("value").alias("smoothed")))


@query(f"WITH {_OBS} SELECT user_id, event_id, CAST(count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rejected FROM obs")
def running_reject_count(spark, d):
    return observations(spark, d).select("user_id", "event_id", SERIES.running_count(~F.col("ok")).alias("rejected"))


# ---- folds

#: A row's name in a series: what a fold's plan carries besides its inputs.
_ROW = ("user_id", "ts", "event_id")


def _recursive(state: str, start: str, step: str, more: str = "") -> str:
    """A recursive twin of a fold: one round per position in the series."""
    return f"""WITH RECURSIVE {_OBS}, o AS MATERIALIZED (SELECT * FROM obs), f AS (
  SELECT user_id, i, event_id, {start} FROM o WHERE i = 0
  UNION ALL SELECT o.user_id, o.i, o.event_id, {step} FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, event_id, {state} FROM f{more}"""


#: The bounds in doubles, as RatioGate's: a decimal 1 - 0.9 is a greater number.
_GATE = "f.s > 0 AND o.value / f.s BETWEEN 1 - CAST(0.9 AS DOUBLE) AND 1 + CAST(0.9 AS DOUBLE)"


@query(_recursive("a AS accepted", "CASE WHEN ok THEN value END AS s, ok AS a", f"CASE WHEN o.ok AND (f.s IS NULL OR ({_GATE})) THEN o.value ELSE f.s END, o.ok AND (f.s IS NULL OR ({_GATE}))"))
def sequential_gate(spark, d):
    """Accept against the last accepted value, not the previous one."""
    e = observations(spark, d).select(*_ROW, "value", "ok")
    out = D.fold(e, "user_id", ["ts", "event_id"], ["value", "ok"], D.RatioGate(0.9), "accepted", "boolean")
    return out.select("user_id", "event_id", "accepted")


@query(_recursive(f"{_r('s')} AS ema", "value AS s", "f.s * 0.8 + o.value * (1 - 0.8)"))
def ema_smooth(spark, d):
    out = D.fold(observations(spark, d).select(*_ROW, "value"), "user_id", ["ts", "event_id"], ["value"], D.Ema(0.8), "ema", "double")
    return rounded(out.select("user_id", "event_id", "ema"))


@query(_recursive(f"{_r('s')} AS ema", "value AS s", "f.s + greatest(-5.0, least(5.0, f.s * 0.7123456789 + o.value * (1 - 0.7123456789) - f.s))"))
def step_limited_ema(spark, d):
    out = D.fold(observations(spark, d).select(*_ROW, "value"), "user_id", ["ts", "event_id"], ["value"], D.Ema(0.7123456789, 5.0), "ema", "double")
    return rounded(out.select("user_id", "event_id", "ema"))


_ROLL = "f.s * 0.8 + greatest(-2.0, least(2.0, o.value / 100)) * (1 - 0.8)"


@query(_recursive(f"{_r('s')} AS angle", "CASE WHEN ok THEN greatest(-2.0, least(2.0, value / 100)) END AS s", f"CASE WHEN NOT o.ok THEN f.s WHEN f.s IS NULL THEN greatest(-2.0, least(2.0, o.value / 100)) WHEN abs(o.value / 100 - f.s) > 0.9 THEN f.s ELSE greatest(-2.0, least(2.0, f.s + greatest(-0.12, least(0.12, {_ROLL} - f.s)))) END"))
def line_roll_follow(spark, d):
    """A roll angle with misses, jumps held, averaging and step limits."""
    e = observations(spark, d).withColumn("angle_in", F.when(F.col("ok"), F.col("value") / 100))
    out = D.fold(e.select(*_ROW, "angle_in"), "user_id", ["ts", "event_id"], ["angle_in"], D.LineRoll(2.0, 0.8, 0.12, 0.9), "angle", "double")
    return rounded(out.select("user_id", "event_id", "angle"))


@query(_recursive(f"{_r('s')} AS blended", "CASE WHEN event_type = 'view' THEN value ELSE 10.0 END AS s", "CASE WHEN NOT o.ok THEN CASE WHEN o.event_type = 'view' THEN o.value ELSE f.s END WHEN o.event_type = 'view' THEN (o.value + 1) * (1 - 0.08) + o.value * 0.08 ELSE o.value + 1 END"))
def detect_flow_blend(spark, d):
    """Predictions corrected towards detections, with their fallbacks."""
    e = observations(spark, d).withColumns({"predicted": F.when(F.col("ok"), F.col("value") + 1), "detected": F.when(F.col("event_type") == "view", F.col("value"))})
    out = D.fold(e.select(*_ROW, "predicted", "detected"), "user_id", ["ts", "event_id"], ["predicted", "detected"], D.Blend(0.08, 0.0, 10.0), "blended", "double")
    return rounded(out.select("user_id", "event_id", "blended"))


# ---- weighted candidates


@query("""WITH s AS (SELECT l_returnflag, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s)
SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE run >= total / 2 GROUP BY l_returnflag""")
def weighted_median(spark, d):
    return A.weighted_median(read(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_quantity"), ["l_returnflag"], "l_discount", "l_quantity")


def _wm(source: str, name: str) -> str:
    return f"""SELECT l_suppkey, min(v) AS {name} FROM (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS total
  FROM (SELECT l_suppkey, v, sum(q) AS w FROM {source} GROUP BY 1, 2)) WHERE run >= total / 2 GROUP BY l_suppkey"""


@query(f"""WITH l AS (SELECT l_suppkey, l_discount * 20 - 1 AS v, l_quantity AS q FROM lineitem), d AS ({_wm("l", "dominant_angle")}),
n AS (SELECT l.*, dominant_angle, abs(v - dominant_angle) <= 0.35 AS near FROM l JOIN d USING (l_suppkey)), near AS (SELECT l_suppkey, v, q FROM n WHERE near), e AS ({_wm("near", "cluster_angle")}),
c AS (SELECT l_suppkey, dominant_angle, count(*) AS candidates, count(*) FILTER (WHERE near) AS inliers, coalesce(sum(q) FILTER (WHERE near), 0.0) AS inlier_length FROM n GROUP BY 1, 2)
SELECT l_suppkey, {_r("dominant_angle")} AS dominant_angle, candidates, inliers, inlier_length, inliers >= 2 AND inlier_length >= 400 AS accepted, CASE WHEN inliers >= 2 AND inlier_length >= 400 THEN {_r("cluster_angle")} END AS accepted_angle FROM c LEFT JOIN e USING (l_suppkey)""")
def dominant_cluster(spark, d):
    """Consensus direction of weighted candidates."""
    li = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") * 20 - 1).alias("v"), F.col("l_quantity").alias("q"))
    return rounded(A.dominant_direction(li, ["l_suppkey"], "v", "q", 0.35, 2, 400.0))


@query(f"SELECT l_returnflag, {_r('avg(l_discount - 0.05)')} AS mean, {_r('stddev_pop(l_discount - 0.05)')} AS std, {_r('quantile_cont(abs(l_discount - 0.05), 0.95)')} AS p95_abs FROM lineitem GROUP BY l_returnflag")
def angle_summary(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("a"))
    return rounded(A.angle_summary(li, ["l_returnflag"], "a"))


# ---- joins


@query("""WITH v AS (SELECT user_id, count(*) + 5 AS frames FROM events GROUP BY user_id), spine AS (SELECT user_id, unnest(range(0, frames)) AS frame FROM v),
t AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS frame, arg_max(event_type <> 'error', event_id) AS accepted FROM events GROUP BY 1, 2)
SELECT s.user_id, s.frame, coalesce(t.accepted, true) OR s.frame = 0 AS reliable FROM spine s LEFT JOIN t ON t.user_id = s.user_id AND t.frame = s.frame""")
def reliability_spine_join(spark, d):
    """Every frame of a series with its last tracker row, missing ones true."""
    e = observations(spark, d)
    videos = e.groupBy("user_id").agg((F.count(F.lit(1)) + 5).alias("frame_count"))
    rows = e.select("user_id", F.floor("value").cast("long").alias("frame"), F.col("ok").alias("accepted"), F.col("event_id").alias("seq"))
    return J.reliability_spine(videos, rows, video="user_id")


@query(f"""WITH {_OBS}, a AS (SELECT user_id, i, value FROM obs), b AS (SELECT user_id, i, value FROM obs WHERE ok), c AS (SELECT user_id, i + 2 AS i, value FROM obs WHERE event_type = 'view')
SELECT coalesce(a.user_id, b.user_id, c.user_id) AS user_id, coalesce(a.i, b.i, c.i) AS i, a.value AS raw_value, b.value AS interpolated_value, c.value AS smoothed_value
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.i = b.i FULL JOIN c ON coalesce(a.user_id, b.user_id) = c.user_id AND coalesce(a.i, b.i) = c.i""")
def three_way_trajectory(spark, d):
    """Full outer join of three series of unlike length."""
    e = observations(spark, d).withColumn("i", SERIES.index().cast("long"))
    parts = {
        "raw": e.select("user_id", "i", "value"),
        "interpolated": e.filter("ok").select("user_id", "i", "value"),
        "smoothed": e.filter("event_type = 'view'").select("user_id", (F.col("i") + 2).alias("i"), "value"),
    }
    return J.ragged(parts, ["user_id", "i"])


@query(f"""WITH {_OBS}, m AS (SELECT user_id, max(i) AS last FROM obs WHERE ok GROUP BY user_id) SELECT o.event_id, o.user_id, p.value AS looked_up FROM obs o JOIN m USING (user_id)
JOIN (SELECT user_id, i, value FROM obs) p ON p.user_id = o.user_id AND p.i = least(o.i + 3, m.last)""")
def clamped_lookup(spark, d):
    """The row three ahead, held at the last accepted index."""
    e = observations(spark, d).withColumn("i", SERIES.index().cast("long"))
    last = e.filter("ok").groupBy("user_id").agg(F.max("i").alias("last"))
    table = e.join(last, "user_id").filter("i <= last").select("user_id", "i", F.col("value").alias("looked_up"))
    rows = e.select("event_id", "user_id", (F.col("i") + 3).alias("i"))
    return J.clamped_lookup(rows, table, "user_id", "i").select("event_id", "user_id", "looked_up")


@query("""SELECT o_orderkey, o_custkey, greatest(0, least(CAST(round_even(o_totalprice / 1000 * 29.97, 0) AS BIGINT), c_custkey + 499)) AS nearest FROM orders JOIN customer ON c_custkey = o_custkey""")
def nearest_frame_join(spark, d):
    """A time's nearest frame in another series, held within it."""
    times = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("video"), (F.col("o_totalprice") / 1000).alias("seconds"))
    videos = read(spark, d, "customer").select(F.col("c_custkey").alias("video"), F.lit(29.97).alias("fps"), (F.col("c_custkey") + 500).alias("frame_count"))
    return J.nearest_frames(times, videos, "video", "seconds").select("o_orderkey", F.col("video").alias("o_custkey"), "nearest")


@query("""SELECT a.event_id, a.user_id, coalesce(b.event_id, -1) AS as_of_event_id, coalesce(b.value, -1.0) AS as_of_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of_join(spark, d):
    """Each purchase's latest view."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = J.as_of(left, e.filter("event_type = 'view'"), "user_id", "ts", ["event_id", "value"], tie="event_id")
    return out.select("event_id", "user_id", F.coalesce("as_of_event_id", F.lit(-1).cast("long")).alias("as_of_event_id"), F.coalesce("as_of_value", F.lit(-1.0)).alias("as_of_value"))


_POINTS = "pts AS (SELECT vec_id, label, i, CAST(embedding[2 * i + 1] AS DOUBLE) * 1000 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 1000 AS y FROM embeddings, range(0, 32) t(i))"


def _points(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    at = lambda k: F.element_at("e", (2 * F.col("i") + k).cast("int")) * 1000
    return e.select("vec_id", "label", F.col("i").cast("long").alias("i"), at(1).alias("x"), at(2).alias("y"))


@query(f"WITH {_POINTS} SELECT a.vec_id, a.i FROM pts a WHERE a.i >= 16 AND NOT EXISTS (SELECT 1 FROM pts b WHERE b.vec_id = a.vec_id AND b.i < 16 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 40.0 * 40.0)")
def near_duplicate_anti(spark, d):
    """New points without a known one within 40 pixels, by grid cells."""
    p = _points(spark, d)
    return J.without_near(p.filter("i >= 16"), p.filter("i < 16"), ["vec_id"], 40.0).select("vec_id", "i")


@query(f"""WITH {_POINTS}, s AS (SELECT a.vec_id, a.i AS l, b.i AS r, -((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS score FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND a.i < 16 AND b.i >= 16),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, l ORDER BY score DESC, r) AS pl, row_number() OVER (PARTITION BY vec_id, r ORDER BY score DESC, l) AS pr FROM s)
SELECT vec_id, l, r, {_r("score")} AS score FROM k WHERE pl = 1 AND pr = 1""")
def mutual_nearest_match(spark, d):
    """Mutually nearest points of two sets within a frame."""
    p = _points(spark, d).select("vec_id", "i", "x", "y")
    a = p.filter("i < 16").withColumnsRenamed({"i": "l", "x": "ax", "y": "ay"})
    b = p.filter("i >= 16").withColumnsRenamed({"i": "r", "x": "bx", "y": "by"})
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    scores = a.join(b, "vec_id").select("vec_id", "l", "r", (-(dx * dx + dy * dy)).alias("score"))
    return rounded(J.mutual_nearest(scores, ["vec_id"], "l", "r", "score"))


@query(f"WITH {_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank FROM pts) SELECT vec_id, i, rank FROM k WHERE rank <= 5")
def top_points(spark, d):
    """The five best points of each frame."""
    return J.top_points(_points(spark, d), ["vec_id"], "x", 5, "i").select("vec_id", "i", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def dimension_lookup(spark, d):
    """A fact's run and its group, by equi-joins."""
    c, n, g = (read(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(g, n["n_regionkey"] == g["r_regionkey"])
    return joined.select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT event_id, user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AS member FROM events")
def membership_flag(spark, d):
    e = read(spark, d, "events")
    return J.flag_members(e.select("event_id", "user_id"), e.filter("event_type = 'signup' and value > 100"), ["user_id"], "member").select("event_id", "user_id", "member")


@query("SELECT 'events' AS source, user_id AS id, value FROM events UNION ALL SELECT 'orders', o_custkey, o_totalprice FROM orders")
def union_scan(spark, d):
    """Rows of several sources, one after the other."""
    a = read(spark, d, "events").select(F.lit("events").alias("source"), F.col("user_id").alias("id"), "value")
    b = read(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"))
    return J.concat_videos(a, b)


@query("SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON user_id = o_custkey WHERE n IS NULL OR o_orderkey % 100 >= n")
def frame_bounds_check(spark, d):
    """Requested frames that their series doesn't have."""
    videos = read(spark, d, "events").groupBy(F.col("user_id").alias("video")).agg(F.count(F.lit(1)).alias("frame_count"))
    asked = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("video"), (F.col("o_orderkey") % 100).alias("frame"))
    return Q.out_of_range(asked, videos).select("o_orderkey", F.col("video").alias("o_custkey"))


# ---- geometry

_QUADS = "quads AS (SELECT vec_id, q, " + ", ".join(f"CAST(embedding[8 * q + {k + 1}] AS DOUBLE) * 1000 AS {'xy'[k % 2]}{k // 2}" for k in range(8)) + " FROM embeddings, range(0, 8) t(q))"
_PICK = {"tl": ("list_min", "{x} + {y}"), "tr": ("list_min", "{y} - {x}"), "br": ("list_max", "{x} + {y}"), "bl": ("list_max", "{y} - {x}")}


def _ordered_sql() -> str:
    keys = {c: "[" + ", ".join(e.format(x=f"x{i}", y=f"y{i}") for i in range(4)) + "]" for c, (_, e) in _PICK.items()}
    at = ", ".join(f"list_position({k}, {_PICK[c][0]}({k})) AS p_{c}" for c, k in keys.items())
    cols = ", ".join(f"[{a}0, {a}1, {a}2, {a}3][p_{c}] AS {c}_{a}" for c in _PICK for a in "xy")
    return f"{_QUADS}, pos AS (SELECT *, {at} FROM quads), ordered AS (SELECT vec_id, q, {cols} FROM pos)"


_ORDERED = _ordered_sql()
_EDGES = """edged AS (SELECT *, sqrt((tr_x - tl_x) * (tr_x - tl_x) + (tr_y - tl_y) * (tr_y - tl_y)) AS top, sqrt((br_x - tr_x) * (br_x - tr_x) + (br_y - tr_y) * (br_y - tr_y)) AS "right",
  sqrt((br_x - bl_x) * (br_x - bl_x) + (br_y - bl_y) * (br_y - bl_y)) AS bottom, sqrt((bl_x - tl_x) * (bl_x - tl_x) + (bl_y - tl_y) * (bl_y - tl_y)) AS "left",
  abs((tl_x * tr_y - tr_x * tl_y) + (tr_x * br_y - br_x * tr_y) + (br_x * bl_y - bl_x * br_y) + (bl_x * tl_y - tl_x * bl_y)) / 2 AS area FROM ordered)"""


def _quads(spark, d, ordered: bool = True):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("q"))
    at = lambda k: F.element_at("e", (8 * F.col("q") + k + 1).cast("int")) * 1000
    quad = F.array(*[G.point(at(2 * i), at(2 * i + 1)) for i in range(4)])
    out = e.select("vec_id", F.col("q").cast("long").alias("q"), quad.alias("quad"))
    return out.withColumn("quad", G.order_corners(F.col("quad"))) if ordered else out


_CORNERS = [f"{c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy"]


def _corner_columns(quad: Column) -> list[Column]:
    return [quad[i][a].alias(f"{c}_{a}") for i, c in enumerate(("tl", "tr", "br", "bl")) for a in "xy"]


@query(f"WITH {_ORDERED} SELECT vec_id, q, {', '.join(f'{_r(c)} AS {c}' for c in _CORNERS)} FROM ordered")
def order_corners(spark, d):
    return rounded(_quads(spark, d).select("vec_id", "q", *_corner_columns(F.col("quad"))))


@query(f"WITH {_ORDERED}, {_EDGES} SELECT vec_id, q, " + ", ".join(f'{_r(chr(34) + c + chr(34))} AS "{c}"' for c in ("top", "right", "bottom", "left", "area")) + f", {_r('(tl_x + tr_x + br_x + bl_x) / 4')} AS center_x, {_r('(tl_y + tr_y + br_y + bl_y) / 4')} AS center_y FROM edged")
def quad_edges_area(spark, d):
    q = _quads(spark, d)
    c = F.col("quad")
    return rounded(q.select("vec_id", "q", *[v.alias(k) for k, v in G.edges(c).items()], G.area(c).alias("area"), G.centroid(c)["x"].alias("center_x"), G.centroid(c)["y"].alias("center_y")))


@query(f"""WITH {_ORDERED}, {_EDGES} SELECT vec_id, q, area / (200.0 * 150.0) BETWEEN 0.2 AND 0.85 AND CASE WHEN ("left" + "right") / 2 <= 0 THEN false ELSE ((top + bottom) / 2) / (("left" + "right") / 2) BETWEEN 1.25 AND 2.35 END AS valid FROM edged""")
def quad_validity(spark, d):
    return _quads(spark, d).select("vec_id", "q", G.quad_is_valid(F.col("quad"), 200.0, 150.0).alias("valid"))


def _near(c: str, step: float) -> str:
    return f'CASE WHEN p."{c}" <= 0 THEN false ELSE e."{c}" / p."{c}" BETWEEN 1 - {step} AND 1 + {step} END'


@query(f"WITH {_ORDERED}, {_EDGES} SELECT e.vec_id, e.q, " + " AND ".join(f'e."{c}" > 0 AND p."{c}" > 0' for c in ("top", "right", "bottom", "left")) + " AND " + " AND ".join([*(_near(c, 0.8) for c in ("top", "right", "bottom", "left")), _near("area", 0.9)]) + " AS ok FROM edged e JOIN edged p ON p.vec_id = e.vec_id AND p.q = e.q - 1")
def geometry_step_gate(spark, d):
    """Each quadrilateral's edges and area against the one before it."""
    s = Series("vec_id", "q")
    q = _quads(spark, d).withColumn("before", s.previous(F.col("quad"))).filter("before is not null")
    return q.select("vec_id", "q", G.geometry_step_ok(F.col("quad"), F.col("before"), 0.8, 0.9).alias("ok"))


_SQUARE = """d0 AS (SELECT *, tr_x - br_x AS dx1, bl_x - br_x AS dx2, tl_x - tr_x + br_x - bl_x AS sx, tr_y - br_y AS dy1, bl_y - br_y AS dy2, tl_y - tr_y + br_y - bl_y AS sy FROM ordered),
d1 AS (SELECT *, dx1 * dy2 - dx2 * dy1 AS den FROM d0), d2 AS (SELECT *, (sx * dy2 - dx2 * sy) / nullif(den, 0) AS g, (dx1 * sy - sx * dy1) / nullif(den, 0) AS h FROM d1),
d3 AS (SELECT *, tr_x - tl_x + g * tr_x AS a, bl_x - tl_x + h * bl_x AS b, tl_x AS c, tr_y - tl_y + g * tr_y AS dd, bl_y - tl_y + h * bl_y AS e, tl_y AS f FROM d2),
adj AS (SELECT vec_id, q, e - f * h AS m0, c * h - b AS m1, b * f - c * e AS m2, f * g - dd AS m3, a - c * g AS m4, c * dd - a * f AS m5, dd * h - e * g AS m6, b * g - a * h AS m7, a * e - b * dd AS m8 FROM d3),
hom AS (SELECT vec_id, q, """ + ", ".join(f"({'1919.0 * ' if k < 3 else '1079.0 * ' if k < 6 else ''}m{k}) / nullif(m8, 0) AS h{k}" for k in range(9)) + " FROM adj)"


def _homographies(spark, d):
    """Every quadrilateral; entries are null where there is no transform."""
    return G.with_canvas_homography(_quads(spark, d), "quad", 1920, 1080, "h").select("vec_id", "q", "h")


def _sig(x: str) -> str:
    """Nine significant digits: entries span many magnitudes."""
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} * pow(10.0, 8 - floor(log10(abs({x})))), 0) / pow(10.0, 8 - floor(log10(abs({x})))) END"


def sig(c: Column) -> Column:
    p = F.pow(F.lit(10.0), 8 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).otherwise(F.round(c * p, 0) / p)


@query(f"WITH {_ORDERED}, {_SQUARE} SELECT vec_id, q, {', '.join(f'{_sig(f'h{k}')} AS h{k}' for k in range(9))} FROM hom")
def homography_4pt(spark, d):
    """The exact transform of a quadrilateral to the canvas."""
    h = _homographies(spark, d)
    return h.select("vec_id", "q", *[sig(F.col("h")[k]).alias(f"h{k}") for k in range(9)])


_W = "nullif(h6 * 7.0 + h7 * 11.0 + h8, 0)"


@query(f"WITH {_ORDERED}, {_SQUARE}, p AS (SELECT vec_id, q, (h0 * 7.0 + h1 * 11.0 + h2) / {_W} AS x, (h3 * 7.0 + h4 * 11.0 + h5) / {_W} AS y FROM hom) SELECT vec_id, q, {_sig('x')} AS x, {_sig('y')} AS y FROM p")
def project_points(spark, d):
    p = _homographies(spark, d).select("vec_id", "q", once(G.project(F.array(G.point(F.lit(7.0), F.lit(11.0))), F.col("h"))[0]).alias("p"))
    return p.select("vec_id", "q", sig(F.col("p.x")).alias("x"), sig(F.col("p.y")).alias("y"))


_INV = ["h4 * h8 - h5 * h7", "h2 * h7 - h1 * h8", "h1 * h5 - h2 * h4", "h5 * h6 - h3 * h8", "h0 * h8 - h2 * h6", "h2 * h3 - h0 * h5", "h3 * h7 - h4 * h6", "h1 * h6 - h0 * h7", "h0 * h4 - h1 * h3"]


@query(f"WITH {_ORDERED}, {_SQUARE}, i AS (SELECT vec_id, q, h0 * ({_INV[0]}) + h1 * ({_INV[3]}) + h2 * ({_INV[6]}) AS det, {', '.join(f'{e} AS a{k}' for k, e in enumerate(_INV))} FROM hom), j AS (SELECT vec_id, q, {', '.join(f'a{k} / nullif(det, 0) AS v{k}' for k in range(9))} FROM i) SELECT vec_id, q, {', '.join(f'{_sig(f'v{k}')} AS v{k}' for k in range(9))} FROM j")
def invert_homography(spark, d):
    h = G.with_inverse(_homographies(spark, d), "h", "v")
    return h.select("vec_id", "q", *[sig(F.col("v")[k]).alias(f"v{k}") for k in range(9)])


_AFFINE = "m AS (SELECT vec_id, q, 1 + x0 / 1000 AS a, y0 / 1000 AS b, x1 AS tx, x2 / 1000 AS c, 1 + y2 / 1000 AS d, y1 AS ty FROM quads)"


def _affines(spark, d):
    q = _quads(spark, d, ordered=False)
    p = [F.col("quad")[i] for i in range(4)]
    zero = F.lit(0.0)
    h = F.array(1 + p[0]["x"] / 1000, p[0]["y"] / 1000, p[1]["x"], p[2]["x"] / 1000, 1 + p[2]["y"] / 1000, p[1]["y"], zero, zero, F.lit(1.0))
    return q.select("vec_id", "q", h.alias("h"))


@query(f"WITH {_QUADS}, {_AFFINE}, s AS (SELECT *, sqrt(a * a + c * c) AS scale_x, sqrt(b * b + d * d) AS scale_y FROM m) SELECT vec_id, q, {_r('tx')} AS translation_x, {_r('ty')} AS translation_y, {_r('degrees(atan2(c, a))')} AS rotation_deg, {_r('scale_x')} AS scale_x, {_r('scale_y')} AS scale_y, {_r('(scale_x + scale_y) / 2')} AS scale_avg, 0.0 + 0 AS perspective_x, 0.0 + 0 AS perspective_y FROM s".replace("0.0 + 0 AS", "CAST(0 AS DOUBLE) AS"))
def motion_components(spark, d):
    return rounded(_affines(spark, d).select("vec_id", "q", G.components(F.col("h")).alias("c")).select("vec_id", "q", "c.*"))


@query(f"WITH {_QUADS} SELECT vec_id, q, {_r('cos(radians(y0)) * (1 + x1 / 1000)')} AS a, {_r('-(sin(radians(y0)) * (1 + x1 / 1000))')} AS b, {_r('x0')} AS tx, {_r('y1')} AS ty FROM quads")
def compose_similarity(spark, d):
    q = _quads(spark, d, ordered=False)
    p = [F.col("quad")[i] for i in range(2)]
    m = G.similarity(p[0]["x"], p[1]["y"], p[0]["y"], 1 + p[1]["x"] / 1000)
    return rounded(q.withColumn("m", m).select("vec_id", "q", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"), F.col("m")[2].alias("tx"), F.col("m")[5].alias("ty")))


@query(f"""WITH {_POINTS}, u AS (SELECT vec_id, x, y, 0.9 * x - 0.2 * y + 5 + i AS u, 0.2 * x + 0.9 * y - 3 - i AS v FROM pts), s AS (SELECT vec_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(x * x + y * y) AS q, sum(x * u + y * v) AS p, sum(x * v - y * u) AS r FROM u GROUP BY vec_id),
t AS (SELECT *, (p - (sx * su + sy * sv) / n) / (q - (sx * sx + sy * sy) / n) AS a, (r - (sx * sv - sy * su) / n) / (q - (sx * sx + sy * sy) / n) AS b FROM s)
SELECT vec_id, n, {_r("a")} AS a, {_r("b")} AS b, {_r("(su - a * sx + b * sy) / n")} AS tx, {_r("(sv - b * sx - a * sy) / n")} AS ty FROM t""")
def lsq_similarity(spark, d):
    """Least-squares similarity from sums."""
    p = _points(spark, d)
    x, y, i = F.col("x"), F.col("y"), F.col("i")
    p = p.select("vec_id", "x", "y", (0.9 * x - 0.2 * y + 5 + i).alias("u"), (0.2 * x + 0.9 * y - 3 - i).alias("v"))
    return rounded(A.lsq_similarity(p, ["vec_id"], "x", "y", "u", "v"))


_COV = "greatest(0.0, quantile_cont({0}, 0.95) - quantile_cont({0}, 0.05))"


@query(f"WITH {_POINTS} SELECT vec_id, {_r(_COV.format('x'))} AS coverage_x, {_r(_COV.format('y') + ' / greatest(1, 1080)')} AS coverage_y, {_r(_COV.format('x / 1919.0'))} AS coverage_n, {_r('quantile_cont(sqrt(x * x + y * y), 0.5)')} AS median_error FROM pts GROUP BY vec_id")
def coverage_and_reprojection(spark, d):
    """The three coverages and the median error of each frame's points."""
    x, y = F.col("x"), F.col("y")
    return rounded(
        _points(spark, d).groupBy("vec_id").agg(
            A.coverage(x).alias("coverage_x"), A.coverage_of_width(y, F.lit(1080)).alias("coverage_y"),
            A.coverage_normalised(x, F.lit(1920.0)).alias("coverage_n"), A.median_reprojection(F.hypot(x, y)).alias("median_error"),
        )
    )


@query(f"WITH a AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, (l_quantity - 25) * 30 AS angle FROM lineitem) SELECT l_orderkey, l_linenumber, {_r('90 - ((90 - angle) - 180.0 * floor((90 - angle) / 180.0))')} AS angle FROM a")
def angle_normalize(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", G.normalize_line_angle((F.col("l_quantity") - 25) * 30).alias("angle")))


@query(f"""WITH a AS (SELECT p_partkey, p_size * 1.0 AS w, p_retailprice / 50 AS h FROM part) SELECT p_partkey, {_r("least(1280 / w, 720 / h, 1.0)")} AS scale, greatest(1, CAST(round_even(h * 320 / w, 0) AS BIGINT)) AS tile,
  {_r("(w * h * 0.7) / greatest(w * h, 1.0)")} AS fill, {_r("greatest(w, h) / greatest(least(w, h), 1.0)")} AS aspect, {_r("greatest(0.0, least(40.0 / least(1280 / w, 720 / h, 1.0), w - 1))")} AS frame_x,
  CAST(round_even(w * 100 * 0.1, 0) AS BIGINT) AS x0, CAST(round_even(w * 100 * (1 - 0.2), 0) AS BIGINT) AS x1 FROM a""")
def display_geometry(spark, d):
    """Display scale, tile size, fill and aspect ratio, canvas points, crops."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("w"), (F.col("p_retailprice") / 50).alias("h"))
    w, h = F.col("w"), F.col("h")
    scale = G.display_scale(w, h, 1280, 720)
    box, fa = G.crop_box(w * 100, h * 100, 0.1, 0.1, 0.2, 0.2), G.fill_and_aspect(w * h * 0.7, w, h)
    at = G.canvas_to_frame(G.point(F.lit(40.0), F.lit(40.0)), scale, w, h)
    return rounded(p.select("p_partkey", scale.alias("scale"), G.tile_height(w, h, 320).alias("tile"), fa["fill"].alias("fill"), fa["aspect"].alias("aspect"), at["x"].alias("frame_x"), box["x0"].alias("x0"), box["x1"].alias("x1")))


# ---- samples, pivots, text


@query("WITH v AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, s AS sample, CAST(round_even(s * (n - 1) / 7.0, 0) AS BIGINT) AS frame FROM v, range(0, 8) t(s)")
def even_frame_sample(spark, d):
    v = read(spark, d, "events").groupBy(F.col("user_id").alias("video")).agg(F.count(F.lit(1)).alias("frame_count"))
    return S.even_frames(v, 8).select(F.col("video").alias("user_id"), F.col("sample").cast("long").alias("sample"), "frame")


@query(f"WITH {_OBS}, s AS (SELECT user_id, event_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM obs WHERE i % 10 = 0) SELECT user_id, event_id, i FROM s WHERE k <= 4")
def stride_sample(spark, d):
    e = observations(spark, d).withColumn("i", SERIES.index().cast("long"))
    return S.stride(e, 10, 4, "user_id", "i").select("user_id", "event_id", "i")


_METHODS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE event_type = '{m}') AS \"{m}\"" for m in _METHODS) + " FROM events GROUP BY user_id")
def method_pivot(spark, d):
    return A.method_pivot(read(spark, d, "events"), ["user_id"], "event_type", "value", _METHODS)


@query(f"SELECT user_id, {_r("max(value) FILTER (WHERE event_type = 'view') / max(value) FILTER (WHERE event_type = 'click')")} AS improvement FROM events GROUP BY user_id")
def improvement_ratio(spark, d):
    return rounded(A.improvement_ratio(read(spark, d, "events"), ["user_id"], "event_type", "value", "view", "click"))


@query(r"SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(p_name || '#' || p_type, '[^\p{L}\p{N}_.-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'run') AS part FROM part")
def clean_path(spark, d):
    return read(spark, d, "part").select("p_partkey", X.clean_path_part(F.concat_ws("#", "p_name", "p_type")).alias("part"))


_F = "CAST(CAST(round_even({0}, 0) AS BIGINT) AS VARCHAR)"


@query(f"WITH {_QUADS} SELECT vec_id, q, " + " || ':' || ".join(f"{_F.format(f'x{i}')} || ',' || {_F.format(f'y{i}')}" for i in range(4)) + " AS corners, " + ", ".join(f"round_even({a}{i}, 0) + 0.0 AS {a}{i}" for i in (0, 3) for a in "xy") + " FROM quads")
def parse_and_format_corners(spark, d):
    """Corners to text and back."""
    q = _quads(spark, d, ordered=False).withColumn("corners", X.format_points(F.col("quad")))
    p = X.parse_corners(F.col("corners"))
    return q.select("vec_id", "q", "corners", *[(p[i][a] + F.lit(0.0)).alias(f"{a}{i}") for i in (0, 3) for a in "xy"])


@query("SELECT p_partkey, p_size || ':' || (p_size + 3) AS frames FROM part")
def parse_frame_list(spark, d):
    """Frame numbers of a text list, blanks skipped."""
    frames = X.parse_frames(F.concat("p_size", F.lit(", ,"), F.col("p_size") + 3))
    return read(spark, d, "part").select("p_partkey", F.array_join(frames.cast("array<string>"), ":").alias("frames"))


@query(f"""WITH {_OBS}, e AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS last_t FROM obs)
SELECT CAST(user_id AS VARCHAR) AS video, count(*) AS pairs, count(*) FILTER (WHERE ok) AS ok_pairs, {_metric_sql("value", "value", "ok")},
  count(*) FILTER (WHERE {_TAIL}) AS last_pairs, count(*) FILTER (WHERE ok AND {_TAIL}) AS last_ok_pairs, {_metric_sql("value", "value", f"ok AND {_TAIL}", "last_")}
FROM e GROUP BY user_id""")
def summary_json(spark, d):
    """The nested summary documents, one a series, written and read again."""
    from datetime import datetime

    from ..sources import scratch
    from ..sources.tables import read_summary, summary_documents

    s, metrics = last_n_seconds_summary(spark, d), ("mean", "p95", "max")

    def part(prefix: str):
        metric = F.struct(*[F.col(f"{prefix}value_{m}").alias(m) for m in metrics])
        return F.struct(F.col(f"{prefix}pairs").alias("pairs"), F.col(f"{prefix}ok_pairs").alias("ok_pairs"), metric.alias("translation_px"))

    rows = s.select(F.struct(F.col("user_id").cast("string").alias("video")).alias("video"), part("").alias("all"), part("last_").alias("last_seconds"))
    path = scratch.folder(spark, "summaries")
    summary_documents(rows, datetime(2026, 1, 1)).write.text(path)
    back = read_summary(spark, path, lines=True)
    out = [F.col("video.video").alias("video")]
    for prefix, name in (("", "all"), ("last_", "last_seconds")):
        out += [F.col(f"{name}.pairs").alias(f"{prefix}pairs"), F.col(f"{name}.ok_pairs").alias(f"{prefix}ok_pairs")]
        out += [F.col(f"{name}.translation_px.{m}").alias(f"{prefix}value_{m}") for m in metrics]
    return rounded(back.select(*out))


@query("SELECT vec_id, 28 AS inliers, CAST(0.9 AS DOUBLE) AS a, CAST(0.2 AS DOUBLE) AS b, CAST(5 AS DOUBLE) AS tx, CAST(-3 AS DOUBLE) AS ty FROM embeddings")
def ransac_similarity(spark, d):
    """Robust similarity of each frame's points, seeded; every eighth is moved,
    so the transform of the others is known."""
    from ..operators.robust import robust_similarities

    p = _points(spark, d)
    x, y, i = F.col("x"), F.col("y"), F.col("i")
    out = F.when(i % 8 == 0, x + 300).otherwise(0.9 * x - 0.2 * y + 5)
    matches = p.select("vec_id", i.alias("index"), x.alias("sx"), y.alias("sy"), out.alias("tx"), (0.2 * x + 0.9 * y - 3).alias("ty"))
    found = robust_similarities(matches, ["vec_id"], 60)
    return rounded(found.select("vec_id", "inliers", *[F.col("transform")[k].alias(n) for n, k in (("a", 0), ("b", 3), ("tx", 2), ("ty", 5))]))


def _stream(spark, d):
    """The events as a stream; a stream's source is a folder or a glob."""
    path = f"{d}/events.parquet"
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(path.replace("events.parquet", "event[s].parquet"))


@query(_SQL["ema_smooth"])
def stream_fold(spark, d):
    """The averaging fold over a stream: equal to the batch fold."""
    from ..streaming.folds import stream_fold as fold
    from ..streaming.run import drain

    stream = _stream(spark, d)
    rows = stream.select("user_id", "event_id", "ts", "value")
    out = fold(rows, "user_id", ["ts", "event_id"], ["value"], D.Ema(0.8), "ema", "double")
    return rounded(drain(out).select("user_id", "event_id", "ema"))


@query(f"""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS pairs, count(*) FILTER (WHERE event_type <> 'error') AS ok_pairs, {_r("avg(value) FILTER (WHERE event_type <> 'error')")} AS mean, {_r("max(value) FILTER (WHERE event_type <> 'error')")} AS max FROM events GROUP BY 1, 2""")
def stream_windows(spark, d):
    """Daily stability counts over a stream, all windows."""
    from ..streaming.folds import windowed_stability
    from ..streaming.run import drain

    stream = _stream(spark, d)
    rows = stream.withColumn("ok", F.col("event_type") != "error")
    out = windowed_stability(rows, "user_id", "ts", "value", "ok").select("user_id", F.col("window.start").alias("start"), "pairs", "ok_pairs", "mean", "max")
    done = drain(out, "complete")
    return rounded(done.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "pairs", "ok_pairs", "mean", "max"))


@query(f"""WITH {_ORDERED}, {", ".join(f"w_{c} AS (SELECT vec_id, q, {c} AS v FROM ordered)" for c in ["tl_x"])} SELECT a.vec_id, a.q, {_r("avg(b.v)")} AS tl_x FROM w_tl_x a CROSS JOIN range(-1, 2) k(o) JOIN w_tl_x b ON b.vec_id = a.vec_id AND b.q = greatest(0, least(7, a.q + k.o)) GROUP BY a.vec_id, a.q""")
def smooth_quads(spark, d):
    """Centred means of a corner trajectory, edges repeated."""
    q = _quads(spark, d)
    rows = q.select("vec_id", "q", *_corner_columns(F.col("quad")))
    return rounded(centred_filter(rows, Series("vec_id", "q"), ["tl_x"], 3, "mean").select("vec_id", "q", "tl_x"))


from . import more, scans, shapes  # noqa: E402, F401  register the rest


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
