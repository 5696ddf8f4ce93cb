"""Embedding near-duplicates by iterative quantisation.

Equal directions are one class, so copies cost one row. A rotation that keeps
vectors far from its sign changes is learned on a bounded sample by alternating
signs and a Procrustes step; vectors aren't centred, as that widens the angles
between vectors that share a mean. Such rotations, from different random starts,
give codes of TABLES words of TABLE_BITS bits, a Hamming table for each, in which a
class is stored and looked up under its own word.
A bit differs with probability acos(c) / pi at cosine c if rotations are random,
so a pair at exactly 0.9 meets in one table with 0.084 and in none of 112 with
5e-5 if tables are independent; words within a bit of it would meet as often in 25
tables, but at 18 rows a table. Of the classes that meet, those whose codes'
first 128 bits differ in at most CUT_DEVIATIONS standard deviations more
than expected at MIN_COSINE are ranked again with the original vectors in double
precision, and pairs with a cosine of MIN_COSINE or more are links. All rows are
indexed and looked up; the sample only fits the rotations.

Vectors of one dimension are a group of their own. Vectors that are null, zero or
hold null or non-finite components link with nothing and are their own component. A null id takes part in links, but never
names a component; repeated ids are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize, with_id
from .components import components

SAMPLE = 10_000
TABLES = 112
TABLE_BITS = 16
CUT_BITS = 128
CUT_DEVIATIONS = 5
MIN_COSINE = 0.9
ROUNDS = 10
SEED = 42


def fit(sample: np.ndarray, turns: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Projection of dimension x bits for unit vectors."""
    d = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample)
    v = sample @ axes
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(turns):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            signs = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(v.T @ signs)
            r = u @ w
        parts.append(axes @ r)
    return np.hstack(parts)


def most_bits(bits: int, least: float) -> int:
    """Differing bits of `bits` at cosine `least` that are hardly ever passed."""
    p = np.arccos(least) / np.pi
    return int(np.ceil(bits * p + CUT_DEVIATIONS * np.sqrt(bits * p * (1 - p))))


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and whether each is usable."""
    good = np.zeros(len(vectors), bool)
    size = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size and size:
            out[i] = np.array([np.nan if c is None else c for c in v] if isinstance(v, list) else v, np.float64)
    finite = np.isfinite(out).all(1)
    out[~finite] = 0
    top = np.abs(out).max(1, initial=0)
    scaled = out / np.where(top > 0, top, 1)[:, None]
    norm = np.sqrt((scaled**2).sum(1))
    good = finite & (norm > 0)
    return scaled / np.where(norm > 0, norm, 1)[:, None], good


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        vectors, units = list(b["vector"]), [None] * len(b)
        for dim in {len(v) for v in vectors if v is not None}:
            own = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
            for i, u, g in zip(own, *_unit([vectors[i] for i in own]), strict=True):
                units[i] = u.tobytes() if g else None
        yield pd.DataFrame({"vec_id": b["vec_id"], "unit": units})


def _words(code: np.ndarray, table_bits: int) -> np.ndarray:
    weight = 1 << np.arange(table_bits, dtype=np.int64)
    n = code.shape[1] // table_bits
    return code[:, : n * table_bits].reshape(len(code), n, table_bits).astype(np.int64) @ weight


def _coded(dim: int, project: np.ndarray, table_bits: int):
    """One row per class and table: (spot, cls, and the code's first bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(-1, dim)
                bits = x @ project >= 0
                code = np.packbits(bits[:, :CUT_BITS], axis=1).view(np.int64)
                words = _words(bits, table_bits)
                n = words.shape[1]
                spot = words + (np.arange(n, dtype=np.int64) << table_bits)
                yield pd.DataFrame(
                    {"spot": spot.reshape(-1), "cls": np.repeat(part["cls"].to_numpy(np.int64), n), "c0": np.repeat(code[:, 0], n), "c1": np.repeat(code[:, 1], n)}
                )

    return run


def _ranked(dim: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            left = np.frombuffer(b"".join(b["ua"]), np.float64).reshape(-1, dim)
            right = np.frombuffer(b"".join(b["ub"]), np.float64).reshape(-1, dim)
            cosine = (left * right).sum(1)
            yield b.loc[cosine >= least, ["a", "b"]].assign(cosine=cosine[cosine >= least])

    return run


def links(classes: DataFrame, dim: int, least: float = MIN_COSINE, sample: int = SAMPLE, tables: int = TABLES, table_bits: int = TABLE_BITS) -> DataFrame:
    """(a, b, cosine), a < b, over classes(cls, unit)."""
    picked = classes.orderBy(F.xxhash64("unit")).limit(sample).select("unit").collect()
    x = np.frombuffer(b"".join(r["unit"] for r in picked), np.float64).reshape(-1, dim) if picked else np.zeros((1, dim))
    bits = max(tables * table_bits, CUT_BITS)
    project = fit(x, turns=-(-bits // dim))[:, :bits]
    coded = classes.mapInPandas(_coded(dim, project, table_bits), "spot long, cls long, c0 long, c1 long")
    left, right = (coded.select("spot", *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "c0", "c1")]) for side in ("l", "r"))
    apart = F.bit_count(F.col("l_c0").bitwiseXOR(F.col("r_c0"))) + F.bit_count(F.col("l_c1").bitwiseXOR(F.col("r_c1")))
    met = left.join(right, "spot").filter((F.col("l_cls") < F.col("r_cls")) & (apart <= most_bits(CUT_BITS, least)))
    pairs = materialize(met.select(F.col("l_cls").alias("a"), F.col("r_cls").alias("b")).distinct(), "itq-pairs")
    left = classes.select(F.col("cls").alias("a"), F.col("unit").alias("ua"))
    right = classes.select(F.col("cls").alias("b"), F.col("unit").alias("ub"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub")
    found = materialize(both.mapInPandas(_ranked(dim, least), "a long, b long, cosine double"), "itq-links")
    discard(pairs)
    return found


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = MIN_COSINE, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(id_text(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    units = materialize(with_id(rows.mapInPandas(_prepared, "vec_id string, unit binary"), "vec_id"), "itq-units")
    real = units.filter("unit is not null")
    classes = real.groupBy("unit").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "itq-classes")
    dims = sorted(r["d"] for r in classes.select((F.octet_length("unit") / 8).cast("int").alias("d")).distinct().collect()) or [1]
    found = [links(classes.filter(F.octet_length("unit") == 8 * d).select("cls", "unit"), d, least, **options) for d in dims]
    found = reduce(DataFrame.unionByName, found)
    size = classes.select("cls", "n")
    ends = found.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    others = ends.join(size.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("n").alias("others"))
    roots = components(found)
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = materialize(named.join(others, "cls", "left"), "itq-named")
    least_of = materialize(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "itq-least")
    told = named.join(least_of, "root").select("unit", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    told = materialize(told, "itq-told")
    linked = real.join(told, "unit").select("vec_id", "n_links", "component_id")
    alone = units.filter("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_itq_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
