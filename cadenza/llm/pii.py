"""Personal data replaced by keyed surrogates.

Detected: e-mail and IP addresses (4 and 6), hardware addresses, payment card
(an issuer's prefix and length, groups of four, or a valid check digit), telephone, social
security and account (IBAN) numbers, and persons named with a title, after a cue such as
"my name is" or "author:", by a known given name and a surname, with initials, or in
Chinese characters before a form of address. A surname found in a text is replaced
wherever else it stands in that text. An entity is its kind and its canonical text, so
its mentions in any case or format get one surrogate (coreference), written in each
mention's own format and case. Digits of all scripts count: an entity is told by their
values, and each mention gets the surrogate's digits in its own script. Telephone numbers
keep their country: those with +1 are one with the bare national number.

Numbers and addresses go through a keyed format-preserving permutation: letters
stay letters of their script (beyond the alphabets below, of their block of 128 characters,
their category and the script in their name), digits digits, and check digits, network prefixes,
address ranges, country codes and mail domains' ends keep their validity. Given names are drawn
by the key from names of the same gender and script (neutral ones if the gender isn't
told), surnames are built in the script. A collision check over the corpus's distinct
entities settles all: numbers are one space and names another, whatever their kinds; a
candidate that is itself a real entity of its space, is taken, or is wanted by two (the
least kind and canonical text win) is drawn again in the next round, so distinct entities
get distinct surrogates and no surrogate is a real entity. Where rounds settle nothing any
more (a range of addresses that is full, say), what is left becomes a mark of its kind and a
keyed number. The key is the caller's; the
query and the pipeline read it from the session's cadenza.pii.key.

A null text stays null, and texts without an entity stay as they are. Repeated
rows, and rows with a null id, are each replaced alike.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: The session setting that holds the key, and what the queries take without it.
KEY_SETTING = "cadenza.pii.key"
DEMO_KEY = "replace-this-key"
#: Rounds of the collision check in a row that may settle nothing.
ROUNDS = 12

# Names by gender and script, titles by gender.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Hans Klaus Jürgen Wolfgang Pierre Jacques François Philippe Carlos Miguel Javier Diego".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Margaret Dorothy Ursula Petra Gisela Sabine Françoise Chantal Sylvie Monique Pilar Lucía Carmen Rosario".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Владимир Михаил Андрей Павел".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Татьяна Наталья Елена Светлана Ирина Екатерина Людмила".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Αγγελική".split(),
    ("n", "latin"): "Alex Robin Sam Kim Jordan Taylor Morgan Casey Jamie Charlie Dominique Andrea Sascha Noa".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Никита".split(),
    ("n", "greek"): "Άλεξ Χάρις Σάσα Κρις".split(),
    ("m", "han"): "伟 强 磊 军 勇 杰 涛 明 刚 平".split(),
    ("f", "han"): "芳 娜 敏 静 丽 艳 娟 霞 玲 燕".split(),
}
SURNAMES_HAN = "王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗"
TITLES = {"m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(), "f": "Mrs Ms Frau Madame Mme Mlle Señora Sra Госпожа Κυρία".split()}
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ha he ka ko la le lo ma mi mo na ne no pa pe ra ri ro sa se so ta te to va ve vi wa we zo".split(),
    "cyrillic": "ба бе бо да де до га го ка ко ла ле ло ма ми мо на не но па пе ра ри ро са се со та те то ва ве ви за зо".split(),
    "greek": "βα βε γα γο δα δε ζα ζο κα κο λα λε μα μι μο να νε νο πα πε ρα ρι σα σε τα τε το φα φι χα".split(),
}
END = {"latin": "n r l s t".split(), "cyrillic": "н р л к в".split(), "greek": "ς ν".split()}

_GENDER = {t: g for g, names in TITLES.items() for t in names}
_KNOWN = {n: (g, s) for (g, s), names in GIVEN.items() if g != "n" and s != "han" for n in names}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΆ-ΏΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+"
_TITLE = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.? ({_CAP}(?:[ -]{_CAP}){{0,2}})(?!\w)")
_NAMED = re.compile(rf"(?<!\w)({'|'.join(sorted(_KNOWN, key=len, reverse=True))}) ({_CAP}(?:-{_CAP})?)(?!\w)")
_PART = rf"(?:{_CAP}|[A-ZА-ЯΑ-Ω]\.)"
_CUES = r"[Mm]y name is|[Nn]ame:|[Aa]uthor:|[Cc]ontact:|[Pp]atient:|[Ee]mployee:|[Ss]igned(?: by|:)|[Rr]egards,|[Ss]incerely,|[Dd]ear|меня зовут|Имя:|Όνομα:"
_CUED = re.compile(rf"(?<!\w)(?:{_CUES})\s({_PART}(?:[ -]{_PART}){{1,3}})(?!\w)")
_LEARNED = re.compile(rf"(?<!\w)(?:Dr|Prof|Doctor|Professor)\.? ({_PART}(?:[ -]{_PART}){{0,3}})(?!\w)")
_HAN = re.compile(rf"([{SURNAMES_HAN}][\u4e00-\u9fff]{{1,2}})(先生|女士|小姐)")
_HINT = re.compile(rf"(?<!\w)(?:{'|'.join([*_GENDER, *_KNOWN])})[. ]|(?<!\w)(?:{_CUES}|Dr|Prof|Doctor|Professor)[. \n]|先生|女士|小姐")
_SIGN = re.compile(r"[\d@:]")
_LABEL = r"[^\W_](?:[^\W_]|-(?=-*[^\W_]))*"
_DOMAIN = re.compile(rf"@({_LABEL}(?:\.{_LABEL})+)")
_NUMBER = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<mac>(?<![\w:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![\w:-]))"
    r"|(?P<card>(?<![\w.-])(?:\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{13,19})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\w|-\d)"
    r"|(?<![\w(])\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\w|-\d)|(?<![\w.-])\d{3}[ .-]\d{3}[.-]\d{4}(?!\w|-\d)|(?<![\w.-])\d{3}-\d{4}(?!\w|-\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
)
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")

LETTERS = ["abcdefghijklmnopqrstuvwxyz", "0123456789", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"]
_CLASS = {c: (a, i) for a in LETTERS for i, c in enumerate(a)}
#: Ranges of addresses whose surrogates stay within them (fixed values); the rest is one range.
RANGES = [ipaddress.ip_network(x) for x in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()]


@lru_cache(65536)
def alphabet_of(c: str) -> tuple[str, int] | None:
    """The characters that can stand for c, and c's place in them; None where
    there are no others. Marks count as letters do."""
    if c in _CLASS:
        return _CLASS[c]
    kind, block = unicodedata.category(c), ord(c) & ~127
    if kind[0] not in "LNM":
        return None
    script = lambda x: unicodedata.name(x, "?").split()[0]
    found = "".join(x for x in map(chr, range(block, block + 128)) if x not in _CLASS and unicodedata.category(x) == kind and script(x) == script(c) and x.lower() == x)
    return (found, found.index(c)) if c in found and len(found) > 1 else None


def _in_local(c: str) -> bool:
    return c.isalnum() or c in "._%+-" or unicodedata.category(c)[0] == "M"


def script_of(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "ё" else "greek" if "ά" <= c <= "ώ" else "latin"


def _digits(s: str) -> str:
    """The digits' values, whatever their script."""
    return "".join(str(int(c)) for c in s if c.isdecimal())


def _as_in(c: str, digit: str) -> str:
    """A digit in the script of the digit c."""
    return chr(ord(c) - int(c) + int(digit))


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _card_ok(digits: str, grouped: bool) -> bool:
    """Groups of four, a network's prefix and length, or a valid check digit."""
    n, two = len(digits), int(digits[:2])
    known = (
        digits[0] == "4" and n in (13, 16, 19)
        or n == 16 and (51 <= two <= 55 or 2221 <= int(digits[:4]) <= 2720 or digits[:4] == "6011" or two == 65 or two == 35)
        or n == 15 and two in (34, 37)
    )
    return grouped or known or luhn_digit(digits[:-1]) == int(digits[-1])


#: Two-digit country codes start with these; 1 and 7 stand alone, all others have three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3


def _phone(raw: str) -> str:
    digits = _digits(raw)
    if not raw.startswith("+"):
        return digits
    return digits[1:] if digits[0] == "1" and len(digits) == 11 else "+" + digits


def _persons(text: str) -> Iterator[tuple[int, int, str, str]]:
    def parts(m: re.Match, group: int, gender: str):
        names = list(re.finditer(_CAP, m[group]))
        for k, n in enumerate(names):
            script = script_of(n[0])
            known = _KNOWN.get(n[0], (gender, script))[0] if gender == "n" else gender
            kind = f"surname_{script}" if k == len(names) - 1 else f"given_{known}_{script}"
            yield m.start(group) + n.start(), m.start(group) + n.end(), kind, n[0].lower()

    for m in _TITLE.finditer(text):
        yield from parts(m, 2, _GENDER[m[1]])
    for m in _NAMED.finditer(text):
        gender, script = _KNOWN[m[1]]
        yield m.start(1), m.end(1), f"given_{gender}_{script}", m[1].lower()
        for n in re.finditer(_CAP, m[2]):
            yield m.start(2) + n.start(), m.start(2) + n.end(), f"surname_{script_of(n[0])}", n[0].lower()
    for pattern in (_CUED, _LEARNED):
        for m in pattern.finditer(text):
            if not any(w in _GENDER for w in re.findall(_CAP, m[1])):
                yield from parts(m, 1, "n")
    for m in _HAN.finditer(text):
        yield m.start(1), m.end(1), f"given_{'m' if m[2] == '先生' else 'f'}_han", m[1]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) by start, not overlapping; earlier kinds
    in this function's order win."""
    found: list[tuple[int, int, str, str]] = []
    if _SIGN.search(text):
        if "@" in text:
            for m in _DOMAIN.finditer(text):
                b = m.start()
                while b and _in_local(text[b - 1]):
                    b -= 1
                while b < m.start() and text[b] == ".":
                    b += 1
                if b < m.start():
                    found.append((b, m.end(), "email", text[b : m.end()].lower()))
        for m in _NUMBER.finditer(text):
            raw = m[0]
            kind = next(k for k in ("ip", "mac", "card", "ssn", "phone", "iban") if m[k])
            if kind == "ip":
                if any(int(x) > 255 for x in raw.split(".")):
                    continue
                canon = str(ipaddress.IPv4Address(".".join(str(int(x)) for x in raw.split("."))))
            elif kind == "mac":
                canon = re.sub("[:-]", "", raw).lower()
            elif kind == "iban":
                canon = "".join(str(int(c)) if c.isdecimal() else c for c in raw if c != " ")
                if not 15 <= len(canon) <= 34 or not _iban_ok(canon):
                    continue
            else:
                canon = _phone(raw) if kind == "phone" else _digits(raw)
                if kind == "card" and not _card_ok(canon, m["gap"] is not None):
                    continue
            found.append((m.start(), m.end(), kind, canon))
        if text.count(":") > 1:
            for m in _IPV6.finditer(text):
                try:
                    found.append((m.start(), m.end(), "ip6", ipaddress.IPv6Address(m[0]).exploded))
                except ValueError:
                    continue
    if _HINT.search(text):
        persons = list(_persons(text))
        found += persons
        again = {text[s:e]: (k, c) for s, e, k, c in persons if k.startswith("surname_") and e - s > 3}
        if again:
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(again, key=len, reverse=True)))})(?!\w)", text):
                found.append((m.start(), m.end(), *again[m[0]]))
    out: list[tuple[int, int, str, str]] = []
    for _, e in sorted(enumerate(found), key=lambda x: (x[1][0], x[0])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _number(key: bytes, *parts) -> int:
    data = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network over the least even
    number of bits, walked until it falls within the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (_number(key, tweak, half, r, right) & mask)
        value = left << half | right
        if value < size:
            return value


def reshape(key: bytes, tweak: str, text: str) -> str:
    """The text with letters and digits permuted within their alphabets, all as
    one number; other characters stay."""
    value, size, shape = 0, 1, []
    for c in text:
        if known := alphabet_of(c):
            alphabet, i = known
            value, size = value * len(alphabet) + i, size * len(alphabet)
            shape.append(alphabet)
        else:
            shape.append(None)
    value = permute(key, tweak + "|" + "".join("." if a is None else str(LETTERS.index(a)) if a in LETTERS else a[0] for a in shape), value, size)
    out = []
    for c, a in zip(reversed(text), reversed(shape), strict=True):
        if a is None:
            out.append(c)
        else:
            value, i = divmod(value, len(a))
            out.append(a[i])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (k % 2 == 0))
        total += d - 9 if d > 9 else d
    return -total % 10


def _syllables(key: bytes, script: str, canon: str, attempt: int, tag: str, n: int) -> str:
    number, parts = _number(key, tag, script, canon, attempt), []
    for _ in range(n):
        number, i = divmod(number, len(SYLLABLES[script]))
        parts.append(SYLLABLES[script][i])
    return "".join(parts) + END[script][number % len(END[script])]


def candidate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical text that attempt number `attempt` proposes."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        keep = labels if re.search(r"(^|\.)example\.(com|org|net)$|\.(test|invalid|example)$", domain) else [reshape(key, "domain", x) for x in labels[:-1]] + labels[-1:]
        grown = local + "".join(str(_number(key, tweak, canon, i) % 10) for i in range(max(0, attempt - 3)))
        return f"{reshape(key, tweak, grown)}@{'.'.join(keep)}"
    if kind == "ip":
        own = ipaddress.IPv4Address(canon)
        net = next((n for n in RANGES if own in n), None)
        if net is not None:
            first = int(net.network_address)
            return str(ipaddress.IPv4Address(first + permute(key, f"{tweak}|{net}", int(own) - first, net.num_addresses)))
        value = int(own)
        while True:
            value = permute(key, tweak, value, 1 << 32)
            if not any(ipaddress.IPv4Address(value) in n for n in RANGES):
                return str(ipaddress.IPv4Address(value))
    if kind == "ip6":
        value = int(ipaddress.IPv6Address(canon))
        return ipaddress.IPv6Address(value >> 96 << 96 | permute(key, tweak, value & (1 << 96) - 1, 1 << 96)).exploded
    if kind == "mac":
        return canon[:2] + f"{permute(key, tweak, int(canon[2:], 16), 1 << 40):010x}"
    if kind == "card":
        body = canon[0] + reshape(key, tweak + canon[0], canon[1:-1])
        return body + str((luhn_digit(body) + int(canon[-1]) - luhn_digit(canon[:-1])) % 10)
    if kind == "iban":
        body = reshape(key, tweak, canon[4:].lower()).upper()
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "phone" and canon[0] == "+":
        n = 1 + _country(canon[1:])
        return canon[:n] + reshape(key, tweak + canon[:n], canon[n:])
    if kind.startswith("given_"):
        _, gender, script = kind.split("_")
        names = GIVEN[gender, script]
        pick = _number(key, tweak, canon)
        if script == "han":
            size = max(1, len(canon) - 1 + (attempt + 3) // 4 - 1)
            return SURNAMES_HAN[pick % len(SURNAMES_HAN)] + "".join(names[_number(key, tweak, canon, i) % len(names)] for i in range(size))
        if attempt == 0:
            return names[pick % len(names)].lower()
        if attempt < 4:
            return f"{names[pick % len(names)]}-{names[pick // len(names) % len(names)]}".lower()
        return f"{names[pick % len(names)]}-{_syllables(key, script, canon, attempt, kind, attempt)}".lower()
    if kind.startswith("surname_"):
        return _syllables(key, kind.split("_")[1], canon, attempt, kind, 3 + attempt // 2)
    return reshape(key, tweak, canon)


def render(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the mention's format, case and digits."""
    if surrogate.startswith("<"):
        return surrogate
    if kind in ("card", "ssn", "phone"):
        surrogate = surrogate.lstrip("+")
        spots = [i for i, c in enumerate(mention) if c.isdecimal()][-len(surrogate) :]
        out = list(mention)
        for i, d in zip(spots, surrogate, strict=True):
            out[i] = _as_in(mention[i], d)
        return "".join(out)
    if kind == "ip":
        own = next(c for c in mention if c.isdecimal())
        return "".join(_as_in(own, c) if c != "." else c for c in surrogate)
    if kind in ("mac", "iban"):
        rest = iter(surrogate)
        out = "".join(next(rest) if c.isalnum() else c for c in mention)
        return out.upper() if mention == mention.upper() else out.lower()
    if kind == "ip6":
        short = ipaddress.IPv6Address(surrogate).compressed
        return short.upper() if mention == mention.upper() != mention.lower() else short
    if kind == "email":
        if mention == mention.upper():
            return surrogate.upper()
        if len(mention) == len(surrogate):
            return "".join(s.upper() if m.isupper() else s for m, s in zip(mention, surrogate, strict=True))
        return surrogate
    if kind.startswith(("given_", "surname_")) and not kind.endswith("han"):
        return "-".join(x.capitalize() for x in surrogate.split("-"))
    return surrogate


_ENTS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("canon", pa.string())]))


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [detect(t) if t else [] for t in b.column("text").to_pylist()]
        ents = pa.array([[{"start": s, "stop": e, "kind": k, "canon": c} for s, e, k, c in f] for f in found], _ENTS)
        yield pa.RecordBatch.from_arrays([b.column("own"), ents], ["own", "ents"])


def _candidates(key: bytes, attempt: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [candidate(key, k, c, attempt) for k, c in zip(b["kind"], b["canon"], strict=True)]
            yield b[["kind", "canon"]].assign(surrogate=made)

    return run


def _marks(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [f"<{k} {_number(key, 'mark', k, c) >> 160:024x}>" for k, c in zip(b["kind"], b["canon"], strict=True)]
            yield b[["kind", "canon"]].assign(surrogate=made)

    return run


def _space() -> Column:
    """Kinds whose surrogates may not be equal."""
    kind = F.col("kind")
    names = kind.startswith("given_") | kind.startswith("surname_")
    return F.when(kind.isin("card", "ssn", "phone"), "number").when(names, "name").otherwise(kind).alias("space")


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, surrogate) for distinct entities(kind, canon); see the
    module's text for the collision check."""
    secret = hashlib.sha256(key.encode()).digest()
    taken = entities.select(_space(), F.col("canon").alias("surrogate"))
    given, pending, attempt, idle, waiting = None, entities.select("kind", "canon"), 0, 0, None
    while True:
        made = pending.mapInPandas(_candidates(secret, attempt), "kind string, canon string, surrogate string").withColumn("space", _space())
        free = made.join(taken, ["space", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select(_space(), "surrogate"), ["space", "surrogate"], "left_anti")
        won = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("e")).select("e.kind", "e.canon", "surrogate")
        won = won if given is None else given.unionByName(won)
        done = materialize(won, "pii-given")
        left = materialize(entities.join(done.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-pending")
        discard(given)
        if attempt:
            discard(pending)
        given, pending, attempt = done, left, attempt + 1
        still = left.count()
        if not still:
            discard(pending)
            return given
        idle, waiting = (idle + 1 if still == waiting else 0), still
        if idle == rounds:
            marked = pending.mapInPandas(_marks(secret), "kind string, canon string, surrogate string")
            return given.unionByName(materialize(marked, "pii-marks"))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, kinds = [], []
        for text, marks in zip(b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
            out, at = [], 0
            for m in sorted(marks, key=lambda m: m["start"]):
                out += [text[at : m["start"]], render(m["kind"], text[m["start"] : m["stop"]], m["surrogate"])]
                at = m["stop"]
            texts.append("".join(out) + text[at:])
            kinds.append(sorted(m["kind"] for m in marks))
        yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["own", "text", "kinds"])


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per input row: own (its columns, a struct), text with every
    detected entity replaced, kinds (array<string>, one per mention, sorted)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("own"), text.alias("text"))
    own = rows.schema["own"].dataType.simpleString()
    found = rows.mapInArrow(_detected, f"own {own}, ents array<struct<start:int,stop:int,kind:string,canon:string>>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    some = F.size("ents") > 0
    text = F.col("own.text").cast("string").alias("text")
    mentions = found.filter(some).select("row", F.explode("ents").alias("e")).select("row", "e.*")
    entities = materialize(mentions.select("kind", "canon").distinct(), "pii-entities")
    chosen = surrogates(entities, key)
    discard(entities)
    marks = mentions.join(chosen, ["kind", "canon"]).groupBy("row").agg(F.collect_list(F.struct("start", "stop", "kind", "surrogate")).alias("marks"))
    hit = found.filter(some).select("row", "own", text).join(marks, "row").select("own", "text", "marks")
    new = hit.mapInArrow(_replace, f"own {own}, text string, kinds array<string>")
    return new.unionByName(found.filter(~some).select("own", text, F.array().cast("array<string>").alias("kinds")))


def session_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs, same columns, with surrogates in text."""
    new = pseudonymise(docs, key)
    return new.select(*[F.col("text") if n == "text" else F.col("own").getField(n).alias(n) for n in docs.columns])


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    from .common import table

    new = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return new.select(F.col("own.doc_id").alias("doc_id"), "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join("kinds", ",").alias("kinds"))
