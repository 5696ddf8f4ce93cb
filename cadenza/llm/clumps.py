"""All pairs of unlike components within groups of near-equal texts, for
simhash.similar_texts(), without a row for a pair.

Rows of a group are dealt to parts of a bounded size; each pair of parts is a run
of rows in a sorted stream, whose pairs a task tests in arrays. What leaves it is
a spanning forest of the links it found, so a group of any size is held exactly
and costs its rows, its parts and those links in rows, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import discard, materialize, partitions
from .components import components
from .forest import Forest

#: Rows of a cell, and rows and bytes of a clump, in a part.
CELL_ROWS = 2000
ROWS = 250
BYTES = 8 << 20
_STEP = 256
_ENTRIES = 4 << 20
_LINKS = "a long, b long"


def _dealt(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """rows(key, cls, ...) for each pair i <= j of their group's parts that they
    take part in; a part weighs about one."""
    counts = rows.groupBy(key).agg(F.ceil(F.sum(weight)).cast("long").alias("parts"))
    named = rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    pairs = named.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = pairs.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "other")
    return pairs.repartition(partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each pair of parts."""
    held = None
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        k = b[[key, "i", "j"]].to_numpy(np.int64)
        at = 0
        for end in (np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist():
            yield b.iloc[at:end]
            at = end
        held = b.iloc[at:]
    if held is not None and len(held):
        yield held


def _linked(run: pd.DataFrame, good) -> pd.DataFrame | None:
    """A forest of the pairs of unlike root, of both parts, that good(rows) gives
    as an array of some rows against all."""
    cls, root, part = (run[c].to_numpy(np.int64) for c in ("cls", "root", "part"))
    if (root == root[0]).all():
        return None
    both, forest = run["i"].iloc[0] != run["j"].iloc[0], Forest(len(run))
    for at in range(0, len(run), _STEP):
        some = slice(at, at + _STEP)
        near = good(some) & (root[some, None] != root)
        if both:
            near &= part[some, None] != part
        a, b = np.nonzero(near)
        forest.join(a + at, b)
    if not forest.links:
        return None
    a, b = np.array(forest.links).T
    return pd.DataFrame({"a": cls[a], "b": cls[b]})


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for run in _runs(batches, "cell"):
        bits = run[list(minhash.SKETCH)].to_numpy(np.int64).view(np.uint64)
        found = _linked(run, lambda some, s=bits: np.bitwise_count(s[some, None] ^ s).sum(2) <= minhash.SKETCH_BITS)
        if found is not None:
            yield found


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share, by products of their 0-1 rows."""
    n = len(sets)
    out, own = np.zeros((n, n)), np.repeat(np.arange(n), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = count > 1
    number, keep = np.cumsum(met) - 1, met[value]
    own, value = own[keep], number[value[keep]]
    order = np.argsort(value, kind="stable")
    own, value = own[order], value[order]
    most, width = int(met.sum()), max(1, _ENTRIES // n)
    for low in range(0, most, width):
        a, b = np.searchsorted(value, [low, low + width])
        held = np.zeros((n, min(width, most - low)), np.float32)
        held[own[a:b], value[a:b] - low] = 1
        out += held @ held.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _alike(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in _runs(batches, "clump"):
            sets = [np.frombuffer(x, np.uint64) for x in r["found"]]
            size, common = np.array([len(s) for s in sets]), common_counts(sets)
            good = common >= least * (size[:, None] + size - common)
            found = _linked(r, lambda some, g=good: g[some])
            if found is not None:
                yield found

    return run


def links(mixed: DataFrame, texts: DataFrame, width: int, least: float, cell_rows: int = CELL_ROWS, rows: int = ROWS) -> DataFrame:
    """(a, b) of alike sets that tie all unlike components together between which
    there is an alike pair that shares a cell and has close sketches. mixed(cell,
    cls, root, sketch) holds the cells of several components, texts(cls, text)
    every class. Close pairs make clumps; in these all pairs are decided by the
    sets themselves."""
    dealt = _dealt(mixed, "cell", F.lit(1 / cell_rows))
    stars = components(materialize(dealt.mapInPandas(_close, _LINKS), "clump-close"))
    named = stars.select(F.col("node").alias("cls"), F.col("root").alias("clump"))
    members = named.unionByName(named.select(F.col("clump").alias("cls"), "clump").distinct())
    roots = mixed.select("cls", "root").distinct()
    sets = texts.join(members.select("cls"), "cls", "left_semi").mapInPandas(minhash.sets(width), "cls long, found binary")
    held = materialize(sets.join(members, "cls").join(roots, "cls"), "clump-sets")
    dealt = _dealt(held, "clump", F.greatest(F.lit(1 / rows), F.octet_length("found") / F.lit(BYTES)))
    done = materialize(dealt.mapInPandas(_alike(least), _LINKS), "clump-links")
    discard(held)
    return done
