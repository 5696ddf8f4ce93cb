"""Periodic runs in word sequences, by Kolpakov and Kucherov's method.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends keeping that period. find_runs() takes the
Lempel-Ziv factors of a sequence from its suffix automaton. At each boundary of
factors Main's algorithm finds the runs that cross or touch it, by longest common
extensions (Z functions) to both sides. All other runs lie inside a factor and
are copied from the earlier occurrence of that factor, where they are known.

Runs of interest have at least `length` words and `exponent` periods (more than
two). Any `reach` words in a row inside such a run occur a second time in it (see
_reach), so a text is first cut down to the stretches all of whose `reach`-grams
repeat in the text; no run leaves a stretch, and its neighbours within the text
decide nothing that the stretch doesn't hold. Texts without such stretches cost
only the split into words.

Empty texts and nulls have no words and no runs. Rows with a repeated or null id
are texts of their own.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, with_id

LENGTH = 24
EXPONENT = 3

Run = tuple[int, int, int]


class SuffixAutomaton:
    """Of a sequence of whole numbers below `letters`. Transitions are in one
    dict by state and letter; a state's letters are a chain in arrays."""

    def __init__(self, seq: list[int], letters: int):
        self.letters = letters
        self.to: dict[int, int] = {}
        self.first_end = array("q", [-1])
        link, size = array("q", [-1]), array("q", [0])
        self._head, self._next, self._letter = array("q", [-1]), array("q"), array("q")
        to, first_end, last = self.to, self.first_end, 0
        for i, c in enumerate(seq):
            now = len(size)
            size.append(size[last] + 1)
            first_end.append(i)
            link.append(0)
            self._head.append(-1)
            p = last
            while p >= 0 and p * letters + c not in to:
                self._edge(p, c, now)
                p = link[p]
            if p >= 0:
                q = to[p * letters + c]
                if size[q] == size[p] + 1:
                    link[now] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    first_end.append(first_end[q])
                    link.append(link[q])
                    self._head.append(-1)
                    e = self._head[q]
                    while e >= 0:
                        self._edge(twin, self._letter[e], to[q * letters + self._letter[e]])
                        e = self._next[e]
                    while p >= 0 and to.get(p * letters + c) == q:
                        to[p * letters + c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now

    def _edge(self, state: int, letter: int, target: int) -> None:
        self.to[state * self.letters + letter] = target
        self._next.append(self._head[state])
        self._letter.append(letter)
        self._head[state] = len(self._letter) - 1


def factors(seq: list[int], letters: int) -> Iterator[tuple[int, int, int | None]]:
    """(start, end, source): the longest string at `start` that also starts
    before it, at `source` (it may overlap itself), or a first letter."""
    found = SuffixAutomaton(seq, letters)
    to, first_end, n, i = found.to, found.first_end, len(seq), 0
    while i < n:
        state = k = 0
        while i + k < n:
            q = to[state * letters + seq[i + k]]
            if first_end[q] - k >= i:
                break
            state, k = q, k + 1
        yield (i, i + k, first_end[state] - k + 1) if k else (i, i + 1, None)
        i += max(1, k)


def z_function(x: list[int]) -> np.ndarray:
    """At k > 0 the length of the longest common prefix of x and x[k:]."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for k in range(1, n):
        v = min(z[k - left], right - k) if k < right else 0
        while k + v < n and x[v] == x[k + v]:
            v += 1
        z[k] = v
        if k + v > right:
            left, right = k, k + v
    return np.array(z, np.int64)


def _at_boundary(seq: list[int], a: int, b: int, e: int, length: int, exponent: float) -> Iterator[Run]:
    """Runs (start, end, period) that cross or touch b and end by e, where
    seq[a:b] and seq[b:e] are factors. A run that passes b starts less than a
    period before a, as the factor at a would be longer otherwise; so its period
    is below e - a and its start within 2 * (b - a) + (e - b) of b."""
    right = e - b
    low = max(0, b - 2 * (b - a) - right)
    left = b - low
    if left + right < length:
        return
    t, u = seq[low:b], seq[b:e]
    back = z_function([*reversed(t), -1, *reversed(u), *reversed(t)])
    ahead = z_function([*u, -1, *t, *u])
    q = np.arange(1, min(right, e - a - 1) + 1)
    before, after = np.minimum(back[left + 1 + right - q], left), np.where(q < right, ahead[np.minimum(q, right)], 0)
    spans = [(q, b - before, b + q + after)]
    q = np.arange(1, min(left, e - a - 1) + 1)
    before, after = np.where(q < left, back[np.minimum(q, left)], 0), np.minimum(ahead[right + 1 + left - q], right)
    spans.append((q, b - q - before, b + after))
    q, start, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    good = (end - start >= length) & (end - start >= exponent * q)
    for q, start, end in zip(q[good].tolist(), start[good].tolist(), end[good].tolist(), strict=True):
        goes_on = end < len(seq) and seq[end] == seq[end - q]
        if not goes_on and not (start and seq[start - 1] == seq[start - 1 + q]):
            yield start, end, q


def find_runs(seq: list[int], length: int = LENGTH, exponent: float = EXPONENT) -> list[Run]:
    """All runs of a sequence of small whole numbers as (start, end, period), by
    start; `exponent` is at least 2."""
    if len(seq) < length:
        return []
    runs: list[Run] = []
    periods: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, q: int) -> None:
        known = periods.get((start, end))
        if known is None or q < known:
            if known is not None:
                runs.remove((start, end, known))
            periods[start, end] = q
            insort(runs, (start, end, q))

    a = 0
    for b, e, source in factors(seq, max(seq) + 1):
        for run in sorted(_at_boundary(seq, a, b, e, length, exponent), key=lambda r: r[2]):
            add(*run)
        if source is not None:
            k = bisect_right(runs, (source, len(seq) + 1, 0))
            while k < len(runs) and runs[k][0] + length <= source + e - b:  # what it adds comes later in the list
                start, end, q = runs[k]
                if end < source + e - b:
                    add(start + b - source, end + b - source, q)
                k += 1
        a = b
    for run in sorted(_at_boundary(seq, a, len(seq), len(seq), length, exponent), key=lambda r: r[2]):
        add(*run)
    return runs


def _reach(length: int, exponent: float) -> int:
    """A window of k words of a run of L words and period q has a copy q words on
    or back inside the run if k <= L - 2 * q; this is the least L - 2 * q."""
    q = int(length // exponent)
    return max(0, min(int(np.ceil(max(length, exponent * p))) - 2 * p for p in (max(q, 1), q + 1)))


_TURN = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray, reach: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of at least `length` numbers whose `reach`-grams all occur
    more than once; equal hashes of unequal ones only make stretches longer."""
    n = len(ids)
    if n < length:
        return []
    if reach < 1:
        return [(0, n)]
    x = (ids.astype(np.uint64) + np.uint64(1)) * _TURN
    x ^= x >> np.uint64(31)
    grams = np.zeros(n - reach + 1, np.uint64)
    for k in range(reach):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + x[k : n - reach + 1 + k]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    marks = np.diff(np.concatenate(([0], (twice[at] == grams).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1) + reach - 1
    return [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= length]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


def runs_of(words: list, length: int = LENGTH, exponent: float = EXPONENT) -> list[Run]:
    """All runs of a list of words as (start, end, period), by start and period."""
    if len(words) < length:
        return []
    ids = np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words))
    found = []
    for start, end in stretches(ids, _reach(length, exponent), length):
        _, part = np.unique(ids[start:end], return_inverse=True)
        found += [(start + s, start + e, q) for s, e, q in find_runs(part.tolist(), length, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, one space between them, that no run holds after its first
    period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, end, q in runs:
        change[start + q] += 1
        change[end] -= 1
    return b" ".join([w for w, deep in zip(words, np.cumsum(change).tolist(), strict=False) if not deep])


_RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id string, n_words long, runs array<{_RUN}>, most {_RUN}, collapsed string"


def _scan(length: int, exponent: float, change: Callable | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                words = change(doc, words) if change else words
                runs = runs_of(words, length, exponent)
                told = [(s, e - s, q) for s, e, q in runs]
                most = max(told, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                rows.append((doc, len(words), told, most, collapsed(words, runs).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "most", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, length: int = LENGTH, exponent: float = EXPONENT, change: Callable | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, one row per row of docs: the whole text's runs by start and
    period, the one of greatest length / period (ties: least start, then period;
    null without runs) and the text without the runs' further periods, its words
    joined by single spaces. `change(id as text, words)` may replace the words
    first."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_id(rows.mapInPandas(_scan(length, exponent, change), SCHEMA), "doc_id")


def planted(doc: str | None, words: list[bytes]) -> list[bytes]:
    """The query's contract: every tenth document by its id's checksum repeats
    words from some place on. A null id changes nothing."""
    h, n = zlib.crc32(doc.encode()) if doc is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


def op13_kolpakov_kucherov(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = periodic_runs(table(spark, sf_dir, "documents"), change=planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    most = F.col("most")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[most[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * most["length"] / most["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
