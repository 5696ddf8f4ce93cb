"""Alignment by segments against whole texts."""

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from cadenza.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\r", "\x0b", "\f", " ", "　", "᠎", "\x1c", "\x85", "a", "the", "Zz9", "naïve", "it's", "'ll", "12", "...", ";", "();", "}", "日本", "語", "é", "ß", "👍🏽", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "word", "x" * 9, "\x00", "i̇", "नमस्ते"]


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def whole(text):
    """Groups of a whole text, by sets of ends."""
    both = ta.pair(A, B)
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    want = (" " + text).encode()
    x, y = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if b"".join(x) != want or b"".join(y) != want:
        return None
    ends = [[sum(map(len, z[: k + 1])) for k in range(len(z))] for z in (x, y)]
    out, last = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, es, strict=True) if last < e <= cut] for ids, es in zip((a, b), ends, strict=True)))
        last = cut
    return out


def test_cuts_are_those_no_piece_goes_across():
    cuts = ta.cut_characters(A, B)
    assert " " in cuts and "\n" in cuts and "\r" not in cuts
    assert ta.splitter(cuts)(" a  b\nc\rd ") == [" a", "  b", "\nc\rd", " "]
    assert ta.splitter("")(" a b") == [" a b"]


def test_segments_have_the_tokens_of_the_whole_text():
    cuts = ta.cut_characters(A, B)
    split, both = ta.splitter(cuts), ta.pair(A, B)
    for text in texts_of(5000, 3) + [" ", "\n", " a", "\ta", "a ", "a \n ", "▁", "a▁b c"]:
        parts = split(" " + text)
        assert "".join(parts) == " " + text
        found = both.align(parts)
        if None in found:
            assert whole(text) is None
        else:
            assert [g for x in found for g in x] == whole(text), repr(text)


def test_codes_of_a_block_come_back():
    groups = [[([70000, 1], [2]), ([3] * 700, [4, 5])], None, [([7], [8])], [([7], [8]), ([7, 9], [8])]]
    codes = [ta.encoded(g) for g in groups]
    place = np.array([2, 0, 3, 1])
    parts = [(ta.packed(place[k]), ta.packed(np.array([len(codes[p]) for p in place[k]])), ta.packed(np.array([x for p in place[k] for x in codes[p]]))) for k in (slice(0, 3), slice(3, 4))]
    found = ta._Alignments(pd.DataFrame(parts, columns=["places", "sizes", "codes"]))
    assert found.bad.tolist() == [False, True, False, False]
    assert found.texts[2:] == ["7|8", "7|8;7,9|8"] and found.texts[1] == "" and found.texts[0].endswith("3,3|4,5")
    assert found.figures.T.tolist() == [[702, 3, 2, 1402], [0, 0, 0, 0], [1, 1, 1, 1], [3, 2, 2, 3]]
    for k, g in enumerate(groups):
        mine = slice(found.starts[k], found.starts[k + 1])
        got = {divmod(int(found.pairs[n]), 1 << 32): int(t) for n, t in zip(found.number[mine], found.times[mine], strict=True)}
        assert got == Counter(p for a, b in g or [] for p in product(a, b))


def plain(texts):
    """Rows from whole texts."""
    groups = [whole(t) if t else None for t in texts]
    links = [Counter(p for a, b in g or () for p in product(a, b)) for g in groups]
    count = Counter(p for x in links for p in x)
    top = {}
    for (a, _), c in count.items():
        top[a] = max(top.get(a, 0), c)
    out = []
    for g, x in zip(groups, links, strict=True):
        g = g or []
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sums = sum(n * count[p] for p, n in x.items()), sum(n for p, n in x.items() if count[p] == top[p[0]])
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sums[1], sums[0], hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def test_rows_equal_those_of_whole_texts(spark, tmp_path):
    texts = texts_of(120, 5) + [" ".join(random.Random(k).choices(BITS[15:], k=200)) for k in range(60)]
    texts += [None, "", "▁", " ▁ a", " ", "z" * 5000, "the end " * 500, "the end " * 500, texts_of(1, 9)[0]]
    rows = [(None if i == 7 else 3 if i == 9 else i, t, "x", "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, segment string, pair string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((-1 if r[0] is None else r[0], *w) for r, w in zip(rows, plain(texts), strict=True))
    for got in (ta.op12_segment_alignment(spark, str(tmp_path)), ta.align(docs.repartition(2), A, B, block_chars=700)):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect())
        assert got == want


def test_groups_as_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in ta.align(docs, A, B).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and rows[2].groups == ""
    assert ta.align(docs.filter(F.lit(False)), A, B).count() == 0
    assert ta.align(docs.filter("doc_id = 2"), A, B).first().n_links == 0
