"""Periodic runs against trying every period."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from cadenza.llm import runs


def brute(x, length, exponent):
    """For every period the maximal stretches that keep it."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            k = i
            while k + q < len(x) and x[k] == x[k + q]:
                k += 1
            size = k - i + q
            if size >= max(length, exponent * q) and k > i:
                found.setdefault((i, k + q), q)
            i = k + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def periodic(rng, n, letters):
    x = []
    while len(x) < n:
        part = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
        x += (part * rng.randint(1, 7))[: rng.randint(1, 40)]
    return x[:n]


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (5, 2), (6, 3), (12, 3), (24, 3), (9, 2.5)])
def test_every_run_is_found(length, exponent):
    rng = random.Random(length * 10 + int(exponent))
    rows = [periodic(rng, rng.randint(0, 90), k) for k in (1, 2, 3, 5, 9) for _ in range(120)]
    rows += [[rng.randrange(2) for _ in range(rng.randint(0, 40))] for _ in range(300)] + [fibonacci(200), [0] * 60, []]
    some = 0
    for x in rows:
        want = brute(x, length, exponent)
        some += len(want)
        assert sorted(runs.find_runs(x, length, exponent), key=lambda r: (r[0], r[2])) == want, x
        if exponent > 2:
            assert runs.runs_of([str(v) for v in x], length, exponent) == want, x
    assert some > 100


def test_factors_are_the_longest_earlier_strings():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        for start, end, source in runs.factors(x, 3):
            longest = max((k for j in range(start) for k in range(len(x) - start + 1) if x[j : j + k] == x[start : start + k]), default=0)
            assert end - start == max(1, longest)
            assert (source is None) == (longest == 0) and (source is None or source < start and x[source : source + end - start] == x[start:end])


def test_long_periodic_texts_take_linear_time():
    rng = random.Random(1)
    part = [str(rng.randrange(10**6)) for _ in range(20_000)]
    began = time.time()
    assert runs.runs_of(part * 4) == [(0, 80_000, 20_000)]
    assert runs.runs_of(["a", "b"] * 50_000 + ["c"]) == [(0, 100_000, 2)]
    assert time.time() - began < 20


def digests(doc, text):
    words = runs.planted(doc, (text or "").encode().split())
    found = brute(words, 24, 3)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return len(found), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_equals_trying_every_period(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(map(str, periodic(rng, rng.randint(0, 300), rng.choice([2, 4, 50])))) for _ in range(150)]
    texts += [None, "", " \n", "a\x1cb  c", "é ü " * 30, "x " * 23, "x " * 24, ("lorem ipsum dolor\t" * 9) + "end"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "q " * 40, "x", "y"), (3, texts[3], "x", "y"), (3, "w " * 30, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op13_kolpakov_kucherov(spark, str(tmp_path)).collect()
    want = sorted((-1 if i is None else i, *digests(None if i is None else str(i), t)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in got) == want
    for r in got:
        assert (r.start is None) == (r.n_runs == 0)
        if r.n_runs:
            assert r.exponent_milli == 1000 * r.length // r.period >= 3000
    assert sum(r.n_runs > 0 for r in got) > 20
    none = runs.periodic_runs(docs.filter(F.lit(False)))
    assert none.columns == ["doc_id", "n_words", "runs", "most", "collapsed"] and none.count() == 0


def test_greatest_exponent_and_ties(spark):
    text = " ".join(["a b"] * 12 + ["x"] + ["c d"] * 12 + ["y"] + ["e"] * 24)
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 24, 2), (25, 24, 2), (50, 24, 1)] and tuple(row.most) == (50, 24, 1)
    assert row.collapsed == "a b x c d y e"
    row = runs.periodic_runs(spark.createDataFrame([(1, text[: text.index(" y")])], "doc_id long, text string")).first()
    assert tuple(row.most) == (0, 24, 2)
