"""Folds against their SQL where the last digit of a constant decides."""

import duckdb
import pytest

from cadenza.plans import catalogue

#: A tenth of the value before; a step of 0.9 from an average.
SERIES = {"sequential_gate": [(0.1, 0.01), (0.2, 0.02), (0.9, 0.09), (0.0, 1.0)], "line_roll_counts": [(95.29, 117.69, 189.77), (95.29, 117.69, 9.77)]}


@pytest.mark.parametrize("name", sorted(SERIES))
def test_equal_at_the_bound(spark, tmp_path, name):
    rows = [(10 * u + k, u, v) for u, series in enumerate(SERIES[name]) for k, v in enumerate(series)]
    duck = duckdb.connect()
    values = ", ".join(f"({e}, TIMESTAMP '2024-01-01' + INTERVAL {e} SECOND, {u}, 'view', CAST({v} AS DOUBLE), '{{}}')" for e, u, v in rows)
    duck.sql(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, e AS value, f AS props FROM (VALUES {values}) t(a, b, c, d, e, f)) TO '{tmp_path}/events.parquet'")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = catalogue.queries()[name](spark, str(tmp_path))
    want = duck.sql(f"SELECT {', '.join(found.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
