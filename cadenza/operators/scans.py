"""Running averages, holds and counts of series of any length, over all tasks.

fold() takes a series in one task. Where a step composes (an average's step is
an affine map, a hold keeps the last value, a count adds) a series can be cut:
rows are range-partitioned by key and order, each part of a key is a block, a
block's whole effect is one row by aggregation, the blocks' effects are chained
(one row a block), and each block then starts from what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .folds import absent, fold


def _start(state, row):
    """Chained blocks: each one's state before it. Inputs: the block's shrink of
    an earlier state, what it adds, its first value."""
    shrink, added, first = row
    if first is None:
        return state, state
    before = first if state is None else state
    return before * shrink + added, before


class _Ema:
    """An average's step from a given state before the block."""

    def __init__(self, weight: float):
        self.weight = weight

    def __call__(self, state, row):
        value, before = row
        state = before if state is None else state
        if absent(value):
            return state, None
        state = state * self.weight + value * (1 - self.weight)
        return state, state


def _blocks(df: DataFrame, key: str, order: list[str], blocks: int | None) -> DataFrame:
    """df, written, with __block: rows of one key and one range of the order."""
    cols = [F.col(c) for c in (key, *order)]
    dealt = df.repartitionByRange(blocks, *cols) if blocks else df.repartitionByRange(*cols)
    return written(dealt.withColumn("__block", F.spark_partition_id()), "scan")


def ema_scan(df: DataFrame, key: str, order: list[str], value: str, weight: float, output: str, blocks: int | None = None) -> DataFrame:
    """folds.Ema(weight) for a series of any length: previous * weight + value *
    (1 - weight), the first value as it is; a null or NaN value has no result and
    changes nothing. The order is unique within a key. A block's effect is the
    weighted sum of its values, with powers that only shrink; sums in another
    order than the fold's differ in the last digits."""
    rows = _blocks(df, key, order, blocks)
    good = F.when(~F.isnan(F.col(value)), F.col(value))
    w = Window.partitionBy(key, "__block").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    later = rows.select(key, "__block", *order, good.alias("__v")).filter("__v is not null").withColumn("__after", F.row_number().over(w) - 1)
    effect = later.groupBy(key, "__block").agg(F.sum(F.pow(F.lit(float(weight)), "__after") * F.col("__v") * (1 - weight)).alias("added"), F.pow(F.lit(float(weight)), F.count("*")).alias("shrink"), F.min_by("__v", F.struct(*order)).alias("first"))
    chained = fold(effect, key, ["__block"], ["shrink", "added", "first"], _start, "before", "double")
    joined = rows.join(chained.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), "before"), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")), "left")
    named = joined.drop("__k", "__b").withColumn("__series", F.concat_ws(":", F.col("__block"), F.col(key).cast("string")))
    out = fold(named, "__series", order, [value, "before"], _Ema(weight), output, "double")
    return out.select(*df.columns, output)


def running(df: DataFrame, key: str, order: list[str], sums: dict[str, Column], holds: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """df with running sums (of whole numbers or doubles; null adds nothing) and
    holds (the last value that isn't null) by key in order, this row included; a
    hold before any value is null."""
    holds = holds or {}
    rows = _blocks(df.withColumns({f"__{n}": c for n, c in (*sums.items(), *holds.items())}), key, order, blocks)
    by = F.struct(*order)
    effect = rows.groupBy(key, "__block").agg(*[F.sum(f"__{n}").alias(n) for n in sums], *[F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), by)).alias(n) for n in holds])
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = effect.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), *[F.sum(n).over(earlier).alias(f"__before_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in holds])
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")))
    here = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.coalesce(F.sum(f"__{n}").over(here), F.lit(0)) + F.coalesce(f"__before_{n}", F.lit(0)) for n in sums}
    out |= {n: F.coalesce(F.last(f"__{n}", ignorenulls=True).over(here), f"__before_{n}") for n in holds}
    return joined.withColumns(out).select(*df.columns, *sums, *holds)
