"""The catalogue's scans: all events as one long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans as S
from .catalogue import _r, observations, query, rounded

_ONE = "one AS (SELECT event_id, event_type <> 'error' AS ok, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)"


def _one_series(spark, d):
    return observations(spark, d).withColumn("series", F.lit(1)).select("series", "ts", "event_id", "ok", "value")


#: Values 150 rows back weigh less than 1e-14.
@query(f"""WITH {_ONE}, v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY i) AS k FROM one WHERE ok), e AS (SELECT a.event_id, sum(b.value * pow(0.8, a.k - b.k) * CASE WHEN b.k = 1 THEN 1.0 ELSE 1 - 0.8 END) AS ema FROM v a JOIN v b ON b.k BETWEEN a.k - 150 AND a.k GROUP BY 1)
SELECT event_id, {_r('ema')} AS ema FROM one LEFT JOIN e USING (event_id)""")
def long_series_ema(spark, d):
    """The average of one series over all tasks; rejected rows have none."""
    rows = _one_series(spark, d).withColumn("value", F.when(F.col("ok"), F.col("value")))
    return rounded(S.ema_scan(rows, "series", ["ts", "event_id"], "value", 0.8, "ema").select("event_id", "ema"))


@query(f"""WITH {_ONE} SELECT event_id, CAST(count(*) FILTER (WHERE NOT ok) OVER w AS BIGINT) AS rejected, last_value(CASE WHEN ok THEN value END IGNORE NULLS) OVER w AS held
FROM one WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def long_series_holds(spark, d):
    """Rejected rows so far and the last accepted value, of one long series."""
    out = S.running(_one_series(spark, d), "series", ["ts", "event_id"], {"rejected": (~F.col("ok")).cast("long")}, {"held": F.when(F.col("ok"), F.col("value"))})
    return out.select("event_id", "rejected", "held")
