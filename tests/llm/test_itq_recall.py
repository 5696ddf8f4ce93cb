"""Links at 0.90 to 0.95 on vectors that share a mean; dimensions side by side."""

import numpy as np
import pytest

from cadenza.llm import itq


def planted(shape, seed=1, n=400, dim=64):
    """Unit vectors, every second one at a cosine of 0.90 to 0.95 to the one before."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean, x = unit(rng.normal(size=dim)), unit(rng.normal(size=(n, dim)))
    common = {"isotropic": np.zeros(n), "common": np.full(n, 0.8), "half in a cone": np.where(np.arange(n) % 2, 0.85, 0.0)}[shape][:, None]
    x = unit(common * mean + np.sqrt(1 - common**2) * x)
    side = rng.normal(size=(n, dim))
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9, 0.95, size=(n, 1))
    return np.stack([x, c * x + np.sqrt(1 - c**2) * side], 1).reshape(2 * n, dim)


@pytest.mark.parametrize("shape", ["isotropic", "common", "half in a cone"])
def test_recall_near_the_bound(spark, shape):
    x = planted(shape)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "cls long, unit binary")
    got = {(r["a"], r["b"]) for r in itq.links(df, 64).collect()}
    cosine = x @ x.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if 0.9 + 1e-9 <= cosine[i, j] <= 0.95}
    recall = len(got & want) / len(want)
    print(f"{shape}: recall {recall:.4f} of {len(want)} links")
    assert recall >= 0.995 and all(cosine[p] >= 0.9 - 1e-9 for p in got)


def test_each_dimension_is_a_group(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [0.0, 1.0]), (6, []), (7, [1.0])]
    out = {(r["vec_id"], r["n_links"], r["component_id"]) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7)}
