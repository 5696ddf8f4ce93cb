"""SimHash groups against all pairs; components against a plain search."""

import random

import numpy as np
import pandas as pd
import xxhash

from cadenza.llm import simhash
from cadenza.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(n, near):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "a B c", "a b c d é É"] + [" ".join(rng.choice("AbcDe") for _ in range(rng.randint(1, 900))) for _ in range(20)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fp(t) for t in texts]


def test_bound_is_a_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 500), np.int64)
    l1 = simhash._l1(simhash.embed(a), simhash.embed(b))
    seg = lambda x: np.array([[bin(int(v) >> 2 * k & 3).count("1") for k in range(32)] for v in x.view(np.uint64)])
    assert (l1 == np.abs(seg(a) - seg(b)).sum(1)).all()
    assert (l1 <= np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))).all()


def near_fps(seed, n):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        v = rng.choice(seeds)
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randint(0, 63)
        out.add(v)
    return sorted(out)


def check_links(spark, fps, **kw):
    want = groups(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)
    rows = pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "node": range(len(fps))})
    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(rows), **kw)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == want


def test_links(spark):
    check_links(spark, near_fps(3, 250))


def test_links_of_hot_cells(spark):
    check_links(spark, near_fps(5, 200), cell_rows=10, piece_rows=4)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(df.limit(0)).collect() == []


def test_edges(spark):
    rows = [(3, "a b c d e"), (1, "a b c d e"), (None, "A b c d e"), (7, None), (5, " "), (5, " "), (None, "x y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    out = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(3, 1), (1, 1), (None, 1), (7, 5), (5, 5), (5, 5), (None, None)], key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_blocks_follow_the_number_of_fingerprints():
    found = [simhash.blocks_for(n, 4) for n in (0, 1, 10**6, 10**7, 10**8, 10**9, 10**10)]
    assert found[:3] == [7, 7, 7] and found == sorted(found) and found[-1] < 14
    assert all(len(simhash.blocks_of(b)) == b for b in found)
