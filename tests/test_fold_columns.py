"""Folds: keys without a value, and columns that only pass by."""

import math

from cadenza.operators.folds import Ema, LineRollDriver, fold
from cadenza.streaming.folds import stream_fold
from cadenza.streaming.run import drain

BIG = 2**62 + 1
ROWS = [(1, 0, BIG, 10.0), (1, 1, None, 20.0), (None, 0, BIG, 10.0), (None, 1, None, 20.0), (BIG, 0, 5, None), (BIG, 1, BIG, float("nan")), (BIG, 2, None, 8.0)]
SCHEMA = "k long, i long, big long, v double"
WANT = {(1, 0, BIG, 10.0), (1, 1, None, 15.0), (None, 0, BIG, 10.0), (None, 1, None, 15.0), (BIG, 0, 5, None), (BIG, 1, BIG, None), (BIG, 2, None, 8.0)}


def test_batch(spark):
    out = fold(spark.createDataFrame(ROWS, SCHEMA), "k", ["i"], ["v"], Ema(0.5), "e", "double")
    assert out.columns == ["k", "i", "big", "v", "e"]
    assert {(r["k"], r["i"], r["big"], r["e"]) for r in out.collect()} == WANT
    assert fold(spark.createDataFrame([], SCHEMA), "k", ["i"], ["v"], Ema(0.5), "e", "double").collect() == []


def test_stream(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = drain(stream_fold(stream, "k", ["i"], ["v"], Ema(0.5), "e", "double"))
    assert {(r["k"], r["i"], r["big"], r["e"]) for r in out.collect()} == WANT


def test_line_roll_counts():
    step, state, seen = LineRollDriver(), None, []
    for v in (None, 0.2, 0.9, 0.3, math.nan, 0.25):
        state, value = step(state, (v,))
        seen.append((round(value[0], 6) if value[0] is not None else None, *value[1:]))
    assert seen == [(None, 0.0, 1.0), (0.2, 1.0, 1.0), (0.2, 1.0, 2.0), (0.22, 2.0, 2.0), (0.22, 2.0, 3.0), (0.226, 3.0, 3.0)]
