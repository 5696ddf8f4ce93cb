"""Repeated strings against counting every 200-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import suffix_dedup
from cadenza.llm.common import scratch

rng = random.Random(3)


def prose(n):
    return "".join(rng.choice("abcdefgh é") for _ in range(n))


def corpus():
    shared, texts = [prose(k) for k in (199, 200, 201, 260, 500, 1200)], []
    for _ in range(70):
        t = prose(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            t += p[rng.randint(0, 30) : len(p) - rng.randint(0, 60)] + prose(rng.choice([0, 1, 5, 300]))
            if rng.random() < 0.4 and len(t) > 50:
                j = rng.randint(0, len(t) - 1)
                t = t[:j] + "X" + t[j + 1 :]
        texts.append(t)
    return texts + [None, "", "ab" * 500, "ab" * 100, "a" * 399, "xyz " * 200, texts[3], texts[3]]


def brute(texts, size=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                mask[i : i + size] = True
        edges = np.diff(np.concatenate(([0], mask.astype(int), [0])))
        kept = bytes(np.frombuffer(r, np.uint8)[~mask])
        out.append((len(r), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 3, "batches": 5, "buffer": 3000}, {"batches": 1, "buffer": 1}, {"batches": 11, "hot": 1}])
def test_against_counting(spark, options):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(df, **options).select("own.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == brute(texts)


def test_anchors_hang_on_the_string_alone():
    inner = prose(200).encode()
    places = set()
    for _ in range(60):
        before, after = prose(rng.randint(0, 3000)).encode(), prose(rng.randint(0, 3000)).encode()
        data = np.frombuffer(before + inner + after, np.uint8)
        _, p, a, b, _, _ = suffix_dedup.anchors(data, np.array([0]), np.array([len(data)]), 200)
        k = int(np.searchsorted(a, len(before), "right")) - 1
        assert a[k] <= len(before) <= b[k]
        places.add(int(p[k]) - len(before))
    assert len(places) == 1


def test_long_texts_are_cut_to_parts_that_share_bytes():
    t = prose(5000)
    raw = t.encode()
    parts = [(data.tobytes(), int(o[0])) for _, data, _, _, o in suffix_dedup._buffers([t], 200, 1, most=700)]
    assert all(raw[o : o + len(d)] == d and len(d) >= 200 for d, o in parts)
    starts = [s for d, o in parts for s in range(o, o + len(d) - 199)]
    assert starts == list(range(len(raw) - 199))


def test_unlike_strings_of_one_mark():
    data = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    at = np.array([0, 4, 8, 12])
    assert suffix_dedup.repeated(data, at, np.zeros(4, np.uint64), 4).tolist() == [True, False, True, False]


def _grams(texts):
    found = Counter()
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        if len(data) >= 200:
            p = suffix_dedup.anchors(data, np.array([0]), np.array([len(data)]), 200)[1]
            found.update(data[i : i + 32].tobytes() for i in p.tolist())
    return found


def test_levels_and_matches_of_arriving_batches(spark):
    shared = [prose(400) for _ in range(5)]
    batches = [[prose(150) + rng.choice(shared) + prose(150) if rng.random() < 0.6 else prose(500) for _ in range(6)] for _ in range(11)]
    path = scratch(spark, "index")
    index, before = suffix_dedup.SuffixIndex(spark, path, 3), Counter()
    for k, texts in enumerate(batches):
        if k == 6:
            index = suffix_dedup.SuffixIndex.open(spark, path)
        df = spark.createDataFrame([(0, t) for t in texts], "batch int, text string")
        met = {bytes(r["gram"]) for r in index.add(suffix_dedup.suffixes(df)).collect()}
        own = _grams(texts)
        assert met == {g for g, n in own.items() if n > 1 or before[g]}
        before += own
    assert [r for r, _, _ in index.levels] == [3, 1, 0]
    total = Counter()
    for _, table, _ in index.levels:
        for r in spark.table(table).collect():
            total[bytes(r["gram"])] += r["n"]
        for part in spark.table(table).groupBy(F.input_file_name()).agg(F.collect_list("gram").alias("g")).collect():
            assert [bytes(x) for x in part["g"]] == sorted(bytes(x) for x in part["g"])
    assert total == before
    plan = index._joined(index.levels[0][1], index.levels[1][1], "inner")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_long_document_and_hot_text(spark):
    passage = prose(260)
    texts = [prose(20_000) + passage + prose(60_000)] + [prose(40) + passage[:250] + prose(60) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(df, hot=10).select("own.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == brute(texts)


def test_edges(spark):
    t = prose(250)
    df = spark.createDataFrame([(None, t, 1), (4, t, 2), (4, None, 3), (4, t, 2)], "doc_id long, text string, runs int")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert sorted(((str(r["doc_id"]), r["text"], r["runs"]) for r in out.collect()), key=str) == sorted([("None", "", 1), ("4", "", 2), ("4", None, 3), ("4", "", 2)], key=str)
    assert suffix_dedup.without_repeats(df.limit(0)).collect() == []
