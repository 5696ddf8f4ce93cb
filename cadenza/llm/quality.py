"""Quality rules with line sequence labelling.

Base rules count words, symbols, repeated lines and repeated three-word windows
over the whole text. A linear-chain conditional random field then marks each
line with a word as content or boilerplate: features describe the line, the
transition weights its neighbours, and the Viterbi path decides. A document is
kept if it passes the base rules and its content lines hold at least
MIN_CONTENT of its words.

The field is fitted here, on at most SAMPLE labelled documents of at most
FIT_CHARS characters, chosen by the hash of their id (documented bounds; everything
else covers all rows): lines of good documents begin as content, unless equal to an
earlier line, and lines of bad ones as boilerplate. Labels are of documents, so the
field is then fitted RELABEL times anew, each time after lines whose own features
speak clearly against their mark have changed it; that leaves sequences with both
kinds of line. Without both kinds of label every line is content.

A null or blank text has no words and fails the base rules. Rows with null or
repeated ids are judged each by its own text. For fitting, a null id or one with
unlike labels isn't used, and of a repeated id the text of least hash is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, with_id

SAMPLE = 2000
FIT_CHARS = 20_000
RELABEL = 3
#: How far a line's own score must lean the other way before its mark changes.
LEAN = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT = 0.5
ROUNDS = 80
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_BLANK = {ord(c): " " for c in "\t\n\v\f\r"}
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SIGNS = SYMBOLS.encode()
FEATURES = 10


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII spaces, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def repeat_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    v = len(index)
    pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].reshape(-1)
    _, window, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[bytes], lines: list[str]) -> tuple[int, int, int, int]:
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    full = [s for s in lines if s.strip(SPACE)]
    return chars, symbols, len(full) - len(set(full)), repeat_words(words)


def line_features(full: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of a text's lines with a word."""
    seen: set[str] = set()
    out = np.zeros((len(full), FEATURES))
    count = np.zeros(len(full), np.int64)
    for i, s in enumerate(full):
        raw = s.encode("utf-8", "surrogatepass")
        words = raw.split()
        n, size = len(words), len(raw)
        upper = size - len(raw.translate(None, _UPPER))
        lower = size - len(raw.translate(None, _LOWER))
        count[i] = n
        out[i] = (
            1,
            min(1, 2 * (size - len(raw.translate(None, _SIGNS))) / n),
            upper / max(1, upper + lower),
            min(1, raw.count(b"!!") / n),
            1 - len(set(words)) / n if n > 4 else 0,
            min(1, 2 * raw.count(b"|") / n),
            s in seen,
            n < 3,
            min(1, 3 * (size - len(raw.translate(None, _DIGIT))) / size),
            min(1, size / n / 20),
        )
        seen.add(s)
    return out, count


@dataclass(frozen=True)
class Crf:
    """Two states, 0 boilerplate and 1 content: state weights by feature,
    transition weights by (from, to)."""

    weight: np.ndarray
    move: np.ndarray

    def viterbi(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each sequence; all advance together. Ties go to
        content."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        size = np.array([len(seqs[i]) for i in order], np.int64)
        longest = int(size[0]) if len(size) else 0
        begin = np.cumsum(size) - size
        emit = np.concatenate([seqs[i] for i in order]) @ self.weight.T if longest else np.zeros((0, 2))
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        best = np.zeros((len(order), 2))
        back = []
        for t, n in enumerate(active.tolist()):
            e = emit[begin[:n] + t]
            if t:
                via = best[:n, :, None] + self.move[None]
                to = (via[:, 1] >= via[:, 0]).astype(np.int8)
                back.append(to)
                best[:n] = np.maximum(via[:, 0], via[:, 1]) + e
            else:
                best[:n] = e
        path = np.zeros(len(emit), np.int8)
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            n = int(active[t])
            path[begin[:n] + t] = state[:n]
            if t:
                inner = size[:n] > t
                rows = np.flatnonzero(inner)
                state[rows] = back[t - 1][rows, state[rows]]
        out: list = [None] * len(seqs)
        for k, i in enumerate(order):
            out[i] = path[begin[k] : begin[k] + size[k]]
        return out


def fit(seqs: list[np.ndarray], labels: list[np.ndarray], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam on the whole sample; forward-backward over all
    sequences at once, position by position."""
    pairs = sorted(((s, y) for s, y in zip(seqs, labels, strict=True) if len(s)), key=lambda p: -len(p[0]))
    size = np.array([len(s) for s, _ in pairs], np.int64)
    x, y = np.concatenate([s for s, _ in pairs]), np.concatenate([y for _, y in pairs])
    begin = np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist()
    first = np.zeros(len(x), bool)
    first[begin] = True
    follow = np.flatnonzero(~first)
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (y[follow - 1], y[follow]), 1)
    seen = np.stack([x[y == k].sum(0) for k in (0, 1)])
    theta = np.zeros(2 * x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weight, move = theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2)
        emit = x @ weight.T
        fore, aft = np.zeros_like(emit), np.zeros_like(emit)
        for t, n in enumerate(active):
            at = begin[:n] + t
            fore[at] = emit[at]
            if t:
                fore[at] += np.logaddexp.reduce(fore[at - 1][:, :, None] + move, axis=1)
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            aft[at - 1] = np.logaddexp.reduce(move + (emit[at] + aft[at])[:, None, :], axis=2)
        total = np.logaddexp.reduce((fore + aft), axis=1)[:, None]
        mean = np.exp(fore + aft - total)
        f = follow
        joint = np.exp(fore[f - 1][:, :, None] + move + (emit[f] + aft[f])[:, None, :] - total[f][:, :, None])
        grad = np.concatenate(((seen - mean.T @ x).reshape(-1), (seen_move - joint.sum(0)).reshape(-1))) / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:-4].reshape(2, -1), theta[-4:].reshape(2, 2))


def relabelled(crf: Crf, seqs: list[np.ndarray], marks: list[np.ndarray]) -> list[np.ndarray]:
    """The marks, changed where a line's own features lean clearly the other
    way; repeated lines stay boilerplate."""
    out = []
    for x, mark in zip(seqs, marks, strict=True):
        lean = x @ (crf.weight[1] - crf.weight[0])
        new = mark.copy()
        new[(mark == 1) & (lean < -LEAN)] = 0
        new[(mark == 0) & (lean > LEAN) & (x[:, 6] == 0)] = 1
        out.append(new)
    return out


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, text) of the labelled documents that the field is
    fitted on: at most `sample` rows."""
    told = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    picked = told.filter("quality = other").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).filter(F.length("text") <= FIT_CHARS).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "quality", F.col("one.text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | None:
    seqs, marks = [], []
    for r in sorted(sample_of(docs, labels, sample).collect(), key=lambda r: r["doc_id"]):
        full = [s for s in r["text"].split("\n") if s.strip(SPACE)]
        x, _ = line_features(full)
        seqs.append(x)
        marks.append(np.where(x[:, 6] > 0, 0, r["quality"]).astype(np.int64) if len(full) else np.zeros(0, np.int64))
    crf = None
    for _ in range(1 + RELABEL):
        marks = relabelled(crf, seqs, marks) if crf else marks
        if len({int(k) for y in marks for k in np.unique(y)}) < 2:
            break
        crf = fit(seqs, marks)
    return crf


_JUDGED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, content_lines long, content_share double"
)


def _judge(crf: Crf | None, names: list[str]):
    columns = [c.split()[0] for c in _JUDGED.split(", ")]

    def rows(texts: list[str]) -> list[tuple]:
        split = [t.split("\n") for t in texts]
        lines = [line_features([s for s in x if s.strip(SPACE)]) for x in split]
        paths = crf.viterbi([x for x, _ in lines]) if crf else [np.ones(len(x), np.int8) for x, _ in lines]
        out = []
        for t, x, (_, per_line), path in zip(texts, split, lines, paths, strict=True):
            words = words_of(t)
            n = len(words)
            chars, symbols, dup, repeat = base_counts(t, words, x)
            failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
            share = float(per_line[path == 1].sum() / n) if n else 0.0
            out.append((n, chars, symbols, dup, repeat, failed, not failed and share >= MIN_CONTENT, len(path), int(path.sum()), share))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k : k + 500]
                judged = pd.DataFrame(rows([t or "" for t in part["text"]]), columns=columns, index=part.index)
                yield pd.concat([part[names], judged], axis=1)

    return run


def judge(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """One row per input row: doc_id, the base counts and verdict, the number of
    lines, of content lines, and the share of words that those hold."""
    rows = docs.select(id_text("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_id(rows.mapInPandas(_judge(crf, ["doc_id"]), "doc_id string, " + _JUDGED), "doc_id")


def keep_good(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    own = rows.schema["own"].dataType.simpleString()
    judged = rows.mapInPandas(_judge(crf, ["own"]), f"own {own}, {_JUDGED}").filter("kept")
    return judged.select(*[F.col("own").getField(n).alias(n) for n in docs.columns])


def op3_line_crf_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    crf = train(docs, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(docs, crf).select(*columns, "n_lines", "content_lines")
