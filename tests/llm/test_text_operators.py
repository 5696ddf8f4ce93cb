"""Packing, quality rules, HTML, pieces, personal data."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import html_text, packing, pieces, pii, quality

WEIRD = ["a  b", " x", "x ", "a \n b", "it's ok", "", "\n", " ", "é ü", "a 　b", "x\0 y", "<|endoftext|> a", "don't 're", "a\tb c", "日本 語 テスト", None, "z" * 5000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")


# ---- packing


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    e = packing.encoder(packing.default_tokenizer())
    rng = random.Random(11)
    bits = ["<|endoftext|>", " ", "  ", "\n", "\t", "é", "naïve", "it's", "'ll", "x", "Zz9", "12", "...", "日本", "\u00a0", "\u3000", "\x1c", "\x85", "(", "ß!", "👍🏽", "ſ"]
    texts = [t or "" for t in WEIRD] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    want = [x.ids for x in Tokenizer.from_file(packing.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert e.plain and any(50256 in w for w in want)
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "Zz9"]) for _ in range(rng.randint(0, 900))) for _ in range(40)] + WEIRD
    df = packing.pack(docs(spark, texts).repartition(3), packing.default_tokenizer(), 128, keep_ids=True)
    rows = df.collect()
    e = packing.encoder(packing.default_tokenizer())
    for i, t in enumerate(texts):
        ids = [*e.model.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in mine)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, parts in by.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 128 or k == max(by)
    whole = packing.sequences(df, 128).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 128 for r in whole[:-1])
    assert packing.pack(docs(spark, texts).limit(0), packing.default_tokenizer()).collect() == []


# ---- quality


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for s in lines:
        if re.search(r"[^\x20\x09-\x0D]", s):
            dup += s in seen
            seen.add(s)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [*WEIRD, *["\n".join(" ".join(rng.choice(["a", "b#", "c|d", "é x", ""]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    for r in quality.judge(docs(spark, texts), None).collect():
        n, chars, symbols, dup, repeat = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)


def test_viterbi_equals_trying_every_path():
    rng = np.random.default_rng(4)
    crf = quality.Crf(rng.normal(size=(2, 3)), rng.normal(size=(2, 2)))
    seqs = [rng.normal(size=(n, 3)) for n in (1, 5, 0, 3, 5)]
    for x, path in zip(seqs, crf.viterbi(seqs), strict=True):
        score = lambda p, x=x: sum(crf.weight[s] @ f for s, f in zip(p, x, strict=True)) + sum(crf.move[a, b] for a, b in zip(p, p[1:], strict=False))
        every = [tuple(k >> i & 1 for i in range(len(x))) for k in range(1 << len(x))]
        assert len(path) == len(x) and np.isclose(score(tuple(path)), max(map(score, every)))


def test_crf_learns_held_out_lines(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["thing", "of", "and", "nation", "word"]) + str(rng.randint(0, 99)) for _ in range(12))
    junk = lambda: " ".join(rng.choice(["Thing", "OF"]) + "###" for _ in range(12))
    rows = [(i, "\n".join((good if i % 2 else junk)() for _ in range(8)), i % 2) for i in range(120)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:80]], "doc_id long, quality int")
    crf = quality.train(df, labels)
    out = {r["doc_id"]: r["kept"] for r in quality.judge(df, crf).collect()}
    assert all(out[i] == bool(q) for i, _, q in rows[80:])
    assert quality.train(df, labels.limit(0)) is None
    mixed = "\n".join([good() for _ in range(6)] + [junk() for _ in range(3)] + [good() for _ in range(4)])
    row = quality.judge(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), crf).first()
    assert (row["n_lines"], row["content_lines"], row["kept"]) == (13, 10, True)
    kept = quality.keep_good(df.withColumn("kept", F.lit(7)), crf)
    assert kept.columns == ["doc_id", "text", "kept"] and {r["kept"] for r in kept.collect()} == {7}


def test_the_sample_is_bounded_and_of_one_row_an_id(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x"), (3, "z" * (quality.FIT_CHARS + 1)), (None, "n"), (4, "d"), (5, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (None, 1), (4, 0), (5, 7)], "doc_id long, quality int")
    rows = quality.sample_of(df, labels).collect()
    assert [(r["doc_id"], r["quality"]) for r in sorted(rows)] == [(1, 1), (4, 0)]
    assert quality.sample_of(df.union(df).repartition(3), labels).orderBy("doc_id").collect() == sorted(rows)
    assert quality.sample_of(df, labels, 1).count() == 1


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold<br>text</b>&nbsp;here.<p>Second &lt;one&gt;
with   space.<ul><li>item one<li>item two</ul><form>Mail: <input></form><section class="comments"><p>Nice post</p></section><div class="ad">Buy</div></article>
<aside>Side</aside><footer>&copy; me</footer><script>var t="</p>";</script></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head & line\nFirst bold text here.\nSecond <one> with space.\nitem one\nitem two"


def test_density_finds_the_text_without_semantic_tags():
    menu = "".join(f'<li><a href="/{i}">menu entry number {i}</a></li>' for i in range(30))
    body = "".join(f"<p>{'Plain words of a long paragraph without links. ' * 5}</p>" for _ in range(4))
    text = html_text.extract(f"<body><div><ul>{menu}</ul></div><div><div>{body}</div></div><div><a href=x>link</a> <a href=y>link</a></div></body>")
    assert text.count("Plain words") == 20 and "menu" not in text and "link " not in text


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</p></div>", "<!-- open", "<script>x", "<a href='", "<p>" * 2000, "<table><tr><td>a<td>b"])
def test_broken_pages(html):
    assert isinstance(html_text.extract(html), str)


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 1)], "page_id long, url string, html string, text int")
    rows = html_text.main_text(df).collect()
    assert sorted(r["n_chars"] for r in rows) == [0, len(html_text.extract(PAGE)), len(html_text.extract(PAGE))]
    assert html_text.main_text(df.limit(0)).collect() == []


# ---- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.default_model())


def test_best_score_and_round_trip(model):
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=pieces.default_model())
    score = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}

    def best(word):
        top = [0.0] + [-np.inf] * len(word)
        for j in range(1, len(word) + 1):
            top[j] = top[j - 1] + score.get(word[j - 1], model.unknown)
            for k in range(max(0, j - model.longest), j):
                if word[k:j] in score:
                    top[j] = max(top[j], top[k] + score[word[k:j]])
        return top[-1]

    rng = random.Random(6)
    texts = ["the nation", "x y", "thing  of", "日本 語"] + ["".join(rng.choice("etaoin shrdlué") for _ in range(60)) for _ in range(60)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        mine = sum(score[model.text[i]] for i in ids.tolist() if i not in model.byte_of)
        lost = sum(1 for c in ("▁" + t.replace(" ", "▁")) if c not in score)
        assert np.isclose(mine + lost * model.unknown, best("▁" + t.replace(" ", "▁")))
    weird = [t or "" for t in WEIRD] + ["\U0001f9d1‍\U0001f4bb", "x▁y", "\x00\x7f\r\n"]
    ids = model.encode(weird)
    assert model.decode_batch(ids) == [t.replace("▁", " ") for t in weird] == [model.decode(x.tolist()) for x in ids]


def test_long_words_and_shared_hashes(model):
    rng = random.Random(7)
    for n in (50, 399, 700):
        words = ["".join(rng.choice("etaoinshrdlué日") for _ in range(n)) for _ in range(3)]
        for w, row in zip(words, model._viterbi(words, n), strict=True):
            assert model._lone(w)[0].tolist() == row.tolist()
    text = "".join(rng.choice("etaoinshrdlué") for _ in range(300_000))
    begin = time.process_time()
    ids = model.encode([text])[0]
    assert time.process_time() - begin < 20 and model.decode(ids.tolist()) == text
    from copy import copy

    false = copy(model)  # a table in which every substring of one length finds a hash
    keys, ids, scores, there, own = model.tables[2]
    false.tables = dict(model.tables)
    want = model._prefix(_two := pieces._points(["zq"], 2))[-1]
    k = int(np.searchsorted(keys, want[0]))
    false.tables[2] = np.insert(keys, k, want), np.insert(ids, k, ids[0]), np.insert(scores, k, 99.0), np.ones_like(there), np.insert(own, k, own[0], axis=0)
    assert false._viterbi(["zq"], 2).tolist() == model._viterbi(["zq"], 2).tolist() and len(_two) == 1


def test_pieces_frames(spark):
    df = docs(spark, WEIRD)
    path = pieces.default_model()
    a = {r["doc_id"]: (r["ids"], r["text"]) for r in pieces.round_trip(df, path).collect()}
    b = {r["doc_id"]: (r["ids"], r["text"]) for r in pieces.decode(pieces.encode(df, path), path).collect()}
    assert a == b and all(a[i][1] == (t or "") for i, t in enumerate(WEIRD))
    assert pieces.round_trip(df.limit(0), path).collect() == []


# ---- personal data

TEXTS = [
    "Mail JOHN.doe@Corp.org or +1 (017) 555-7713, card 4111-1111-1111-1111!",
    "again john.doe@corp.org and 4111111111111111, from 10.0.0.1 and 97.51.17.173.",
    "Mr. John Smith met Frau Müller; Smith wrote DE89 3704 0044 0532 0130 00.",
    "2001:db8::ff at 00:1A:2B:3C:4D:5E, ssn 123-45-6789, (217) 555-0000",
    "clean text with 12 numbers, 3.5 and 2024-01-01 12:30:00.",
    None,
    "",
]


def test_detection():
    kinds = [[k for _, _, k, _ in pii.detect(t)] if t else [] for t in TEXTS]
    assert kinds[0] == ["email", "phone", "card"] and kinds[1] == ["email", "card", "ip", "ip"]
    assert kinds[2] == ["given_m_latin", "surname_latin", "surname_latin", "surname_latin", "iban"]
    assert kinds[3] == ["ip6", "mac", "ssn", "phone"] and kinds[4:] == [[], [], []]


def test_permutation_is_one():
    for n in (1, 2, 7, 1000):
        assert sorted(pii.permute(b"k", "t", i, n) for i in range(n)) == list(range(n))


def test_surrogates_keep_validity():
    key = b"0" * 32
    card = pii.candidate(key, "card", "4111111111111111", 0)
    assert card[0] == "4" and pii.luhn_digit(card[:-1]) == int(card[-1])
    assert pii._iban_ok(pii.candidate(key, "iban", "DE89370400440532013000", 1))
    assert pii.candidate(key, "ip", "10.0.0.1", 0).startswith("10.") or pii._scope(pii.ipaddress.IPv4Address(pii.candidate(key, "ip", "10.0.0.1", 0)))[0]
    assert pii.candidate(key, "given_f_cyrillic", "анна", 0).capitalize() in pii.GIVEN["f", "cyrillic"]


def test_replacement(spark):
    df = docs(spark, TEXTS).withColumn("kinds", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in pii.without_pii(df, "key").collect()}
    assert pii.without_pii(df, "key").columns == df.columns
    assert out[4:7] if isinstance(out, list) else [out[i] for i in (4, 5, 6)] == TEXTS[4:]
    old = {(k, c) for t in TEXTS if t for _, _, k, c in pii.detect(t)}
    new = {(k, c) for t in out.values() if t for _, _, k, c in pii.detect(t)}
    assert not old & new and len(old) == len(new)
    a = pii.detect(out[0]), pii.detect(out[1])
    assert a[0][0][3] == a[1][0][3] and a[0][2][3] == a[1][1][3]
    assert re.search(r"[A-Z]{4}\.[a-z]{3}@[A-Z][a-z]{3}\.org", out[0]) and re.search(r"\d{4}-\d{4}-\d{4}-\d{4}!", out[0])
    assert pii.without_pii(df.limit(0), "key").collect() == []


def test_collisions_are_drawn_again(spark):
    canon = [f"a{i}@example.com" for i in range(10)] + [f"b{i}@example.com" for i in range(10)]
    names = [f"name{i}" for i in range(60)]
    rows = [("email", c) for c in canon] + [(k, n) for n in names for k in ("given_f_greek", "given_n_greek", "surname_greek", "given_m_han")]
    rows += [(k, f"{i:09d}") for i in range(40) for k in ("ssn", "phone")]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    made = [(r["kind"], r["surrogate"]) for r in out]
    space = [("name" if "_" in r["kind"] else r["kind"], r["surrogate"]) for r in out]
    assert len(set(space)) == len(space)
    assert len(out) == len(rows) == len(set(made)) and not set(made) & set(rows)


def test_detection_by_context():
    told = lambda t: [(t[s:e], k) for s, e, k, _ in pii.detect(t)]
    assert told("Dr. Priya Raghunathan met them. Raghunathan left.") == [("Priya", "given_n_latin"), ("Raghunathan", "surname_latin"), ("Raghunathan", "surname_latin")]
    assert told("my name is Wei Zhang, author: J. R. Tolkien") == [("Wei", "given_n_latin"), ("Zhang", "surname_latin"), ("Tolkien", "surname_latin")]
    assert told("меня зовут Анна Петрова") == [("Анна", "given_f_cyrillic"), ("Петрова", "surname_cyrillic")]
    assert told("我是王伟先生。") == [("王伟", "given_m_han")]
    assert told("New York and Machine Learning, Dear reader") == []
    local = "x" * 80
    assert told(f"to {local}@example.org now") == [(f"{local}@example.org", "email")]
    assert [k for _, k in told("1234567890123456 and 4539578763621486 or 1234567890123452")] == ["card", "card"]
    phones = [c for _, _, _, c in pii.detect("+1 212 555 0000, +44 212 555 0000, 212-555-0000")]
    assert phones == ["2125550000", "+442125550000", "2125550000"]


def test_distinct_and_one_surrogate_each_over_a_corpus(spark):
    """Every line is a lead, one mention and an end, so each surrogate can be
    read off; compared with the entities that made the lines."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    made = []  # (entity, forms)
    for _ in range(60):
        e = f"{word()}.{word()}@{word()}.com"
        made.append((("email", e), [e, e.upper(), e.title()]))
        n = digits(10)
        made.append((("phone", n), [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}"]))
        made.append((("phone", "+44" + n), [f"+44 {n[:3]} {n[3:6]} {n[6:]}"]))
        c = "4" + digits(15)
        made.append((("card", c), [c, "-".join(c[k : k + 4] for k in range(0, 16, 4))]))
        d = digits(9)
        made.append((("ssn", d), [f"{d[:3]}-{d[3:5]}-{d[5:]}"]))
        ip = ".".join(str(rng.randint(1, 250)) for _ in range(4))
        made.append((("ip", ip), [ip]))
        made.append((("surname", w := word().capitalize()), [f"Mr {w}", f"Prof. {w}", f"Frau {w}"]))
    lines = [(e, rng.choice(forms)) for e, forms in made for _ in range(3)]
    rng.shuffle(lines)
    texts = ["\n".join(f"of <{m}> end" for _, m in lines[k : k + 10]) for k in range(0, len(lines), 10)] + ["nothing here " * 50_000 + "<212-555-0101>"]
    out = {r["doc_id"]: r["text"] for r in pii.without_pii(docs(spark, texts), "secret").collect()}
    assert len(out[len(texts) - 1]) == len(texts[-1]) and out[len(texts) - 1] != texts[-1]
    new = [x for k in range(len(texts) - 1) for x in out[k].split("\n")]

    def plain(kind, mention):
        if kind in ("phone", "card", "ssn"):
            d = re.sub(r"\D", "", mention)
            return "+" + d if mention.startswith("+44") else d[-10:] if kind == "phone" else d
        return mention.split(" ")[-1].lower() if kind == "surname" else mention.lower()

    to = {}
    for (entity, old), line in zip(lines, new, strict=True):
        got = re.fullmatch("of <(.+)> end", line)[1]
        assert plain(entity[0], old) == entity[1].lower()
        assert re.sub(r"\w", "", old) == re.sub(r"\w", "", got) and (not old.isupper() or got.isupper())
        assert to.setdefault(entity, plain(entity[0], got)) == plain(entity[0], got)
    space = lambda kind: "number" if kind in ("phone", "card", "ssn") else kind
    found = [(space(k), v) for (k, _), v in to.items()]
    assert len(set(found)) == len(found) == len({e for e, _ in made})
    assert not set(found) & {(space(k), c.lower()) for k, c in to}
    again = {r["doc_id"]: r["text"] for r in pii.without_pii(docs(spark, texts[::-1]), "secret").collect()}
    assert sorted(again.values()) == sorted(out.values())


def test_large_ids_beside_null(spark):
    big = 2**62 + 1
    df = spark.createDataFrame([(big, "the same text of words", big), (None, "other", None)], "doc_id long, text string, n_chars long")
    from cadenza.llm import secrets, simhash

    for out in (simhash.near_duplicates(df), secrets.find_secrets(df), packing.pack(df, packing.default_tokenizer()), pieces.encode(df, pieces.default_model()), quality.judge(df, None)):
        assert {r["doc_id"] for r in out.collect()} == {big, None}
    long = spark.createDataFrame([(big, " ".join(map(str, range(99))), big), (None, " ".join(map(str, range(99))), None)], df.schema)
    assert {(r["doc_id"], r["n_chars"]) for r in quality.keep_good(long, None).collect()} == {(big, big), (None, None)}
