"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from cadenza.llm import minhash

from .test_simhash_components import groups


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(words, k, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"x{rng.getrandbits(40)}"
    return out


def near_texts(seed=1, families=40):
    rng = random.Random(seed)
    texts = ["", None, "One two", "one  two", "one three", " \n"]
    for n in (100, 300, 1000):
        for f in range(families):
            base = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
            texts.append(" ".join(base))
            texts.append(" ".join(edited(base, 1 + f % 4 * n // 100, rng)))
            if f == 0:
                hot = edited(base, 0, rng)
                texts += [" ".join(edited(hot, n // 100, rng)) for _ in range(30)]
    return texts


def bands(sets, linked):
    """{lower edge: (pairs, of them linked)} for 0.80, 0.85, 0.90, 0.95."""
    out = {}
    for i in range(len(sets)):
        for j in range(i):
            s = similarity(sets[i], sets[j])
            if s >= 0.8:
                at = min(0.95, int(s * 20) / 20)
                n, k = out.get(at, (0, 0))
                out[at] = n + 1, k + linked(i, j)
    return out


def test_stage_against_all_pairs(spark):
    texts = near_texts()
    sets = [brute_set(t) for t in texts]
    roots = groups(len(texts), lambda i, j: similarity(sets[i], sets[j]) >= 0.8)
    rows = [(i, t, 0 if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i, r in enumerate(roots) if r == i]
    assert min(bands(sets, lambda i, j: True).items())[1][0] > 10  # pairs at 0.80 to 0.85 are there to be missed
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_sketch_and_minima_follow_the_similarity():
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(400)]
    a, b = minhash.shingles(" ".join(base)), minhash.shingles(" ".join(edited(base, 9, rng)))
    true = similarity(set(a.tolist()), set(b.tolist()))
    assert abs((minhash.minima(a) == minhash.minima(b)).mean() - true) < 0.12
    assert minhash.alike(a, a) and minhash.alike(a, b) == (true >= 0.8)


def test_rows_are_decided_by_row_not_by_id(spark):
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(120)) for _ in range(8)]
    near = " ".join(edited(text[0].split(), 1, rng))
    rows = [(1, text[0], "a"), (5, near, "a"), (5, text[1], "a"), (5, text[2], "a"), (5, text[2], "b"), (5, text[2], "b"), (None, text[3], "a"), (None, text[3], "b"), (None, text[0], "a"), (7, text[4], "a"), (None, text[4], "a"), (None, None, "a"), (9, "", "a")]
    for n in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        want = [(1, text[0]), (5, text[1]), (5, text[2]), (None, text[3]), (7, text[4]), (9, "")]
        assert sorted(out, key=str) == sorted(want, key=str)
