"""Connected components of many graphs at once, one a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

ROUNDS = 60


def _state(links: DataFrame, key: list[str]) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*key, "u", "v").cast("decimal(38,0)"))).first())


def _least(links: DataFrame, key: list[str]) -> DataFrame:
    return links.groupBy(*key, "u").agg(F.min("v").alias("low"))


def components(links: DataFrame, key: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(*key, node, root) of every node of links(*key, a, b) but each component's
    least, which is the others' root. Rounds of stars: each node's greater
    neighbours are tied to the least node it sees, then its lesser ones; a round
    is two aggregations and two joins on (key, node), whose results are written, and
    rounds grow with the logarithm of a component's size. Keys and ends aren't
    null."""
    two = links.select(*key, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now = written(two.distinct(), "links")
    before = _state(now, key)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        both = now.unionByName(now.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        wide = both.join(_least(both, key), [*key, "u"]).filter("v > u")
        wide = written(wide.select(*key, F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct(), "links")
        low = _least(wide, key)
        near = wide.join(low, [*key, "u"]).filter("v <> low").select(*key, F.col("v").alias("u"), F.col("low").alias("v"))
        after = written(near.unionByName(low.withColumnRenamed("low", "v")).distinct(), "links")
        drop(now, wide)
        now, state = after, _state(after, key)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no end in {ROUNDS} rounds")
    return now.select(*key, F.col("u").alias("node"), F.col("v").alias("root"))
