"""Groups of near-equal texts whose original isn't there."""

import random

import numpy as np

from cadenza.llm import clumps, minhash, simhash
from cadenza.llm.common import materialize


def variants(n, words, changed, seed):
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 9999)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for k in rng.sample(range(words), changed):
            text[k] = f"n{rng.randint(0, 99999)}"
        yield " ".join(text)


def brute_roots(sets, least):
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if minhash.alike(sets[i], sets[j], least):
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    return up


def test_a_group_makes_rows_by_its_size(spark, monkeypatch):
    texts = list(variants(220, 150, 3, 1))
    rows = spark.createDataFrame([(f"{k:03d}", t) for k, t in enumerate(texts)], "row string, text string")
    written = []

    def counted(df, name):
        out = materialize(df, name)
        written.append((out.count(), name))
        return out

    for module in (simhash, minhash, clumps):
        monkeypatch.setattr(module, "materialize", counted, raising=False)
    found = {r.row: r.component for r in simhash.similar_texts(rows).collect()}
    sets = [minhash.shingles(t) for t in texts]
    want = brute_roots(sets, minhash.LEAST)
    got = [found[f"{k:03d}"] for k in range(len(texts))]
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got)) > 1
    assert max(written)[0] <= minhash.BANDS * len(texts)


def test_parts_leave_no_pair_out(spark):
    texts = [*variants(40, 120, 2, 2), *variants(25, 120, 2, 3)]
    sets = [minhash.shingles(t) for t in texts]
    common = clumps.common_counts(sets)
    assert all(common[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets))
    held = spark.createDataFrame(list(enumerate(texts)), "cls long, text string")
    words = [minhash.minima(s) for s in sets]
    bits = [np.packbits((w >> np.uint64(31) ^ w >> np.uint64(17)) & np.uint64(1) == 1).view(np.int64).tolist() for w in words]
    mixed = spark.createDataFrame([(7, k, k, *b) for k, b in enumerate(bits)], "cell long, cls long, root long, " + ", ".join(f"{s} long" for s in minhash.SKETCH))
    want = brute_roots(sets, minhash.LEAST)
    for parts in (1000, 9):
        up = list(range(len(texts)))
        for r in clumps.links(mixed, held, minhash.WIDTH, minhash.LEAST, parts, parts).collect():
            assert minhash.alike(sets[r.a], sets[r.b])
            up = [min(up[r.a], up[r.b]) if u in (up[r.a], up[r.b]) else u for u in up]
        assert up == want
