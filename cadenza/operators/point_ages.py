"""Which tracked points live, and how long: a row keeps a point (a new one comes
in with an age of one, a known one gets a year older) or drops it. The step serves
fold() over tables and, with the points in a map of Spark's own state, streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .folds import fold


def absent(value) -> bool:
    return value is None or value != value


def _step(ages: dict, point, kept) -> tuple[float, float]:
    """Ages after a row, and (the point's age, living points); a null point or
    no word on it changes nothing."""
    if not absent(point) and kept is not None:
        if kept:
            ages[point] = ages.get(point, 0) + 1
        else:
            ages.pop(point, None)
    return float(ages.get(point, 0)), float(len(ages))


def _folded(state, row):
    ages = dict(state or {})
    return ages, list(_step(ages, *row))


def point_ages(df: DataFrame, key: str, order: list[str], point: str, kept: str) -> DataFrame:
    """df with age (of the row's point, 0 if it isn't tracked) and points (how
    many are) after each row of its series in order."""
    out = fold(df, key, order, [point, kept], _folded, "__now", "array<double>")
    return out.select(*df.columns, F.col("__now")[0].cast("long").alias("age"), F.col("__now")[1].cast("long").alias("points"))


class _Tracked(StatefulProcessor):
    """A series' points in a map state, point to age, and their number in a value
    state: a batch reads and writes the points it names, not all of them."""

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ages = handle.getMapState("ages", StructType([StructField("point", StringType())]), StructType([StructField("age", LongType())]))
        self.count = handle.getValueState("points", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf.columns = [*self.names, "__series", "__point", "__kept"]  # Spark renames what begins with an underscore
        pdf = pdf.sort_values(self.order, kind="stable", na_position="first")
        n = self.count.get()[0] if self.count.exists() else 0
        points = pdf["__point"].tolist()
        # each point of the batch is read and written once: every call is a message to the JVM
        before = {p: self.ages.getValue((p,))[0] if self.ages.containsKey((p,)) else 0 for p in dict.fromkeys(points) if not absent(p)}
        now, ages, living = dict(before), [], []
        for point, kept in zip(points, pdf["__kept"].tolist(), strict=True):
            if not absent(point):
                if kept == "true":
                    n += not now[point]
                    now[point] += 1
                elif kept == "false" and now[point]:
                    now[point], n = 0, n - 1
            ages.append(0 if absent(point) else now[point])
            living.append(n)
        for point, age in now.items():
            if age and age != before[point]:
                self.ages.updateValue((point,), (age,))
            elif before[point] and not age:
                self.ages.removeKey((point,))
        self.count.update((n,))
        yield pdf[self.names].assign(age=ages, points=living)

    def close(self) -> None:
        pass


def stream_point_ages(stream: DataFrame, key: str, order: list[str], point: str, kept: str) -> DataFrame:
    """point_ages() over a stream: each batch's rows of a key in order after all
    earlier ones. Whole numbers in the stream's columns aren't null."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its process doesn't get the session's path
    rows = stream.withColumns({"__series": F.col(key).cast("string"), "__point": F.col(point).cast("string"), "__kept": F.col(kept).cast("string")})
    schema = StructType([*stream.schema.fields, StructField("age", LongType()), StructField("points", LongType())])
    return rows.groupBy("__series").transformWithStateInPandas(_Tracked(order, stream.columns), schema, "Append", "None")
