"""Personal data in every script."""

import ipaddress
import time
import unicodedata

import pytest

from cadenza.llm import pii

KEY = b"k" * 32
ZEROS = {"arabic": 0x660, "devanagari": 0x966, "full": 0xFF10, "bengali": 0x9E6, "thai": 0xE50}
NUMBERS = ["+49 170 123 4567", "555-123-4567", "078-05-1120", "4111 1111 1111 1111", "10.20.30.40", "8.8.4.4"]


def in_script(text, zero):
    return "".join(chr(zero + int(c)) if c.isdigit() else c for c in text)


@pytest.mark.parametrize("script", ZEROS)
@pytest.mark.parametrize("number", NUMBERS)
def test_digits_of_every_script(script, number):
    text = in_script(number, ZEROS[script])
    found = pii.detect(f"x {text} y")
    plain = pii.detect(f"x {number} y")
    assert [f[2:] for f in found] == [p[2:] for p in plain] and len(found) == 1, "the script must not decide what is found"
    (_, _, kind, canon) = found[0]
    made = pii.render(kind, text, pii.candidate(KEY, kind, canon, 0))
    assert {unicodedata.name(c).rsplit(" ", 1)[0] for c in made if c.isdecimal()} == {unicodedata.name(c).rsplit(" ", 1)[0] for c in text if c.isdecimal()}
    own = pii.render(kind, number, pii.candidate(KEY, kind, canon, 0))
    assert pii._digits(made) == pii._digits(own) and pii._digits(made) != pii._digits(text)
    assert sum(a != b for a, b in zip(pii._digits(made), pii._digits(text), strict=False)) >= 2


MAILS = ["张三@firma.cn", "łukasz.żółć@poczta.pl", "דוד.כהן@דואר.co.il", "محمد@شركة.com", "иван@почта.рф", "नमस्ते@example.in", "김철수@회사.kr", "たろう@会社.jp", "jürgen_ø@bücher.de", "abc123@x.org"]


@pytest.mark.parametrize("mail", MAILS)
def test_letters_of_every_script(mail):
    found = pii.detect(f"write to {mail} now")
    assert [(f[2], f[3]) for f in found] == [("email", mail)]
    made = pii.candidate(KEY, "email", mail, 0)
    local, domain = mail.split("@")
    mine, other = made.split("@")
    assert len(mine) == len(local) and other.rsplit(".", 1)[1] == domain.rsplit(".", 1)[1]
    same = sum(a == b for a, b in zip(mine, local, strict=True) if a.isalnum())
    assert same <= max(1, len(local) // 2) and mine != local
    for a, b in zip(local, mine, strict=True):
        if a.isalpha():
            assert unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0]


def test_permutations_of_any_letters_are_one_to_one():
    for text in ("łż", "דk", "张"):
        alphabets = [pii.alphabet_of(c)[0] for c in text]
        every = [""]
        for a in alphabets:
            every = [e + c for e in every for c in a]
        assert len({pii.reshape(KEY, "t", e) for e in every}) == len(every)
        assert all(all(c in a for c, a in zip(pii.reshape(KEY, "t", e), alphabets, strict=True)) for e in every[:50])


def test_addresses_stay_in_their_range_at_once():
    began = time.time()
    for address in ("169.254.7.9", "192.0.2.5", "127.0.0.1", "10.1.2.3", "224.0.0.9", "8.8.8.8", "0.1.2.3", "100.64.3.4", "255.1.1.1"):
        own = ipaddress.ip_address(address)
        made = ipaddress.ip_address(pii.candidate(KEY, "ip", address, 0))
        assert [own in n for n in pii.RANGES] == [made in n for n in pii.RANGES]
    assert time.time() - began < 2


def test_full_ranges_end_no_job(spark):
    rows = [("ip", f"192.0.2.{k}") for k in range(256)] + [("ip", "8.8.8.8"), ("phone", "5551234567")]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "key", rounds=2).collect()
    assert len(got) == 258 and len({r.surrogate for r in got}) == 258
    assert not {r.surrogate for r in got} & {c for _, c in rows}
    marks = [r for r in got if r.surrogate.startswith("<")]
    assert {r.kind for r in marks} == {"ip"} and len(marks) == 256
    assert pii.render("ip", "192.0.2.7", marks[0].surrogate) == marks[0].surrogate


def test_such_texts_pass_through_a_table(spark):
    text = "call 1 ٠٥٠-١٢٣-٤٥٦٧ or １２３-４５６７, card ١٢٣٤-١٢٣٤-١٢٣٤-١٢٣٤, mail 张三@firma.cn"
    row = pii.without_pii(spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string"), "key").orderBy("id").collect()
    assert row[1].text is None and row[2].text == ""
    for gone in ("٠٥٠-١٢٣-٤٥٦٧", "１２３-４５６７", "١٢٣٤-١٢٣٤", "张三", "firma"):
        assert gone not in row[0].text
    assert row[0].text.startswith("call 1 ")
