"""Streaming forms: the sequential folds with per-key state, and windowed
stability counts with a watermark."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType, _parse_datatype_string
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Step


def stream_fold(stream: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, output: str, kind: str, start: Any = None) -> DataFrame:
    """fold() over a stream: each micro-batch's rows of a key are taken in order
    (nulls first) after all earlier ones, and the state is kept between batches.
    Whole numbers travel as text: pandas would hold them beside nulls as doubles."""
    whole = {f.name: f.dataType for f in stream.schema.fields if isinstance(f.dataType, IntegralType)}
    fields = [StructField(f.name, StringType()) if f.name in whole else f for f in stream.schema.fields]
    schema = StructType([*fields, StructField(output, _parse_datatype_string(kind))])
    rows = stream.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole}).withColumn("__series", F.col(f"`{key}`").cast("string"))

    def value(name: str, x):
        missing = x is None or x is pd.NaT or x != x
        return None if missing else int(x) if name in whole else x

    def run(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start
        pdf = pd.concat(list(parts), ignore_index=True)
        by = [[value(c, x) for x in pdf[c].tolist()] for c in order]
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: [(v[i] is not None, v[i]) for v in by])]
        values = []
        for row in zip(*[pdf[c].tolist() for c in inputs], strict=True):
            now, made = step(now, tuple(value(c, x) for c, x in zip(inputs, row, strict=True)))
            values.append(made)
        state.update((pickle.dumps(now),))
        yield pdf.drop(columns="__series").assign(**{output: values})

    made = rows.groupBy("__series").applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
    return made.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in whole.items()})


def windowed_stability(stream: DataFrame, key: str, time: str, value: str, ok: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Pairs, accepted pairs, mean and greatest accepted value of each tumbling
    window; rows later than `late` fall away."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    used = F.when(F.col(ok), F.col(value))
    grouped = timed.groupBy(F.window("__t", window), key)
    return grouped.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(ok).alias("ok_pairs"), F.avg(used).alias("mean"), F.max(used).alias("max"))
