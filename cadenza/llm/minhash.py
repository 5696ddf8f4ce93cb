"""Minima of word shingles, for SimHash's near-duplicates by similarity
(simhash.similar_texts): what fingerprints are too coarse to find.

Texts are compared as sets of shingles of WIDTH words; a text of fewer words is
one shingle, a text without words the empty set, which equals itself alone.
Equal sets are one class, so copies cost one row. Classes meet where one of
BANDS groups of GROUP minima agrees: a pair at similarity s is missed with
probability (1 - s ** GROUP) ** BANDS, 3e-6 at 0.8. One bit of each of MINIMA
minima makes a sketch; two at 0.8 differ in 10 % of the bits on average, and
pairs beyond SKETCH_BITS are left (missed at 0.8 with 1e-5). Whatever passes is
decided by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

WIDTH = 5
LEAST = 0.8
BANDS = 32
GROUP = 5
MINIMA = 256
SKETCH_BITS = 48
SEED = 42
_CHUNK = 1024
_TURNS, _SHIFTS = np.random.default_rng(SEED).integers(0, 2**64, (2, MINIMA), np.uint64, endpoint=False)
_TURNS |= np.uint64(1)
SKETCH = ("s0", "s1", "s2", "s3")


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, n)
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, n - k + 1))


def minima(found: np.ndarray) -> np.ndarray:
    """MINIMA least values of a set under different orders."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(found), _CHUNK):
            x = found[k : k + _CHUNK] * _TURNS[:, None] + _SHIFTS[:, None]
            np.minimum(out, x.min(1), out=out)
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


SIGNED = "row string, cls long, fp long, cells array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def signatures(width: int, fold):
    """Of rows(row, text): SIGNED, where fold gives a set's fingerprint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, text in zip(b["row"], b["text"], strict=True):
                found = shingles(text, width)
                low = minima(found)
                bands = low[: BANDS * GROUP].reshape(BANDS, GROUP)
                cells = np.array([xxhash.xxh3_64_intdigest(v.tobytes(), k) for k, v in enumerate(bands)], np.uint64)
                # the low bits of a product with an odd number hang on few bits of the value
                sketch = np.packbits((low >> np.uint64(31) ^ low >> np.uint64(17)) & np.uint64(1) == 1).view(np.uint64)
                cls = xxhash.xxh3_64_intdigest(found.tobytes(), SEED)
                rows.append((row, *_signed(np.array([cls, fold(found)], np.uint64)), _signed(cells), *_signed(sketch)))
            yield pd.DataFrame(rows, columns=["row", "cls", "fp", "cells", *SKETCH])

    return run


def sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cls": b["cls"], "found": [shingles(t, width).tobytes() for t in b["text"]]})

    return run


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common)


def _decided(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = zip(b["fa"], b["fb"], strict=True)
            good = np.fromiter((alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in pairs), bool, len(b))
            yield b.loc[good, ["a", "b"]]

    return run


def close(left: str, right: str):
    """The sketches of two sides differ in few bits."""
    apart = sum(F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in SKETCH)
    return apart <= SKETCH_BITS


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of (a, b) those whose sets are alike; texts(cls, text) has every class."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    found = materialize(texts.join(ends, "cls", "left_semi").mapInPandas(sets(width), "cls long, found binary"), "minhash-sets")
    both = pairs.join(found.select(F.col("cls").alias("a"), F.col("found").alias("fa")), "a")
    both = both.join(found.select(F.col("cls").alias("b"), F.col("found").alias("fb")), "b")
    done = materialize(both.mapInPandas(_decided(least), "a long, b long"), "minhash-links")
    discard(found)
    return done
