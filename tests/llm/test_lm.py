"""The language model against one counted in dicts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import lm


class Plain:
    """Interpolated modified Kneser-Ney, straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [None] * (order + 1)
        top = Counter()
        self.plain = Counter()
        for t in texts:
            x = ["<"] * (order - 1) + lm.words_of(t) + [">"]
            self.plain.update(x[order - 1 :])
            top.update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
        self.counts[order] = top
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cuts, self.followers = [None], [None]
        for k in range(1, order + 1):
            c = Counter(self.counts[k].values())
            self.cuts.append((0.0, *lm.discounts([c[1], c[2], c[3], c[4]])))
            by = defaultdict(list)
            for g, n in self.counts[k].items():
                by[g[:-1]].append(n)
            self.followers.append(by)
        self.n, self.v = sum(self.plain.values()), len(self.plain)

    def p(self, gram):
        k = len(gram)
        below = self.p(gram[1:]) if k > 1 else 1 / (self.v + 1)
        after, cut = self.followers[k].get(gram[:-1]), self.cuts[k]
        if not after:
            return below
        n = self.counts[k].get(gram, 0)
        left = sum(cut[min(m, 3)] for m in after)
        return (max(n - cut[min(n, 3)], 0) + left * below) / sum(after)

    def row(self, text):
        x = ["<"] * (self.order - 1) + lm.words_of(text) + [">"]
        tokens = x[self.order - 1 :]
        base = sum(math.log10((self.plain[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in tokens)
        score = sum(math.log10(self.p(tuple(x[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(x)))
        return len(tokens), sum(self.plain[w] > 0 for w in tokens), base, score


def texts_of(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for _ in range(n):
        line, at = [words[0]], 0
        for _ in range(rng.randint(0, 30)):
            at = (at * 7 + rng.randint(0, 3)) % 60
            line.append(words[at] if rng.random() < 0.8 else f"x{rng.randrange(500)}")
        out.append(" ".join(line))
    return out + [None, "", " \t", "A a\x1cb Ä ä", "w1 " * 700, "w1 " * 700, "z" * 3000, "end > <"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_the_definition(spark, order):
    texts = texts_of(200, order)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "w1 w2", "x", "y"), (3, texts[3], "x", "y"), (3, "w5 w9", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, shard string").repartition(3)
    out = lm.every_fifth()
    train = [t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    model = lm.train(docs.filter(~out), order, chunk=500, shard_bytes=2000)
    plain = Plain(train, order)
    assert model.shards > 3 and (model.tokens, model.distinct) == (plain.n, plain.v)
    got = lm.scored(docs, model, out, chunk=300).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    want = sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, *plain.row(t)) for i, t, *_ in rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    texts = texts_of(60, 9)
    for order in (2, 3):
        plain = Plain(texts, order)
        for head in [("<",) * (order - 1), (b"w1",) * (order - 1), (b"unseen",) * (order - 1)]:
            total = sum(plain.p((*head, w)) for w in plain.plain) + plain.p((*head, b"never"))
            assert total == pytest.approx(1)


def test_query_beats_its_base_on_held_out_texts(spark, tmp_path):
    texts = texts_of(400, 5)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lm.op11_kneser_ney_scores(spark, str(tmp_path))
    sums = got.groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).collect()
    for r in sums:
        assert 10 ** (-r.s / r.n) < 0.7 * 10 ** (-r.b / r.n)
    first = got.select(lm.perplexity(F.col("score"), F.col("n_tokens")).alias("p")).first()
    assert first.p > 1


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(empty, lm.every_fifth()).count() == 0
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.scores(one, F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in sorted(rows)] == [(3, 0, 0.0), (1, 0, 0.0)]


def test_large_numbers_stay_whole(tmp_path):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    values = np.stack([np.arange(1000, dtype=np.uint64) ** np.uint64(3), np.full(1000, 254, np.uint64), np.full(1000, 255, np.uint64)])
    lm.write_arrays(f"{tmp_path}/a", keys, values)
    found = lm.Arrays(f"{tmp_path}/a").find(np.concatenate(([np.uint64(1)], keys)), [0, 2, 1])
    assert found[:, 1:].tolist() == values[[0, 2, 1]].tolist() and not found[:, 0].any()


def test_distinct_rows_of_many_columns():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 3, 500) + (1 << 30) for _ in range(5)]
    first, count = lm.distinct_rows(columns, 1 << 31)
    want = Counter(zip(*[c.tolist() for c in columns], strict=True))
    assert {tuple(int(c[i]) for c in columns): int(n) for i, n in zip(first, count, strict=True)} == want
