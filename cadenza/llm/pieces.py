"""SentencePiece encoding by batched Viterbi, and decoding.

A model's normal pieces and scores are read from its file. A text gets the
model's dummy prefix, spaces become U+2581, and it is cut before each run of
them; no piece holds that sign after another character (checked on loading), so
the best segmentation of the text is that of its words. Each distinct word is
segmented once: words of equal length are rows of one array and advance
together. For every end position and piece length a rolling hash of the
substring is looked up among the sorted hashes of the pieces of that length and
compared with the piece found, and vectorised maxima keep the best score and its
backpointer; of equal scores the longest last piece wins. Characters without a piece
become byte pieces. A word of more than LONE characters, such as a text without
spaces, is segmented by itself, with the same result.

The scores decide for any model type: of a model made by merging, too, this
gives the segmentation of greatest total score, not its order of merges, so ids can
differ from the library's there. Texts are taken as they are: rules of normalisation
in the model's file aren't applied. Decoding
inverts encoding exactly but for U+2581 itself, which comes back as a space.
A null text is empty and has no ids. Rows with null or repeated ids are encoded
each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, with_id

SPACE = "▁"
CACHE_WORDS = 600_000
CHUNK_CHARS = 1_000_000
GROUP = 20_000
#: Characters beyond which a word is segmented by itself.
LONE = 400
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A substring's hash, shifted so, is its place in a table's bitmap.
_SHIFT = np.uint64(46)


def _signs(points: np.ndarray) -> np.ndarray:
    x = points.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if len(self.byte) != 256:
            raise ValueError("the model lacks byte pieces")
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses words")
        self.own_lines = not any("\n" in self.text[i] for i in plain)
        self.skip = {i for i in range(n) if m.is_control(i) or m.is_unknown(i)}
        self.longest = max(len(self.text[i]) for i in plain)
        self.unknown = min(m.get_score(i) for i in plain) - 10
        self.tables = {}
        for size in sorted({len(self.text[i]) for i in plain}):
            ids = np.array([i for i in plain if len(self.text[i]) == size])
            keys = self._prefix(_points([self.text[i] for i in ids], size))[-1]
            order = np.argsort(keys)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces share a hash")
            scores = np.array([m.get_score(int(i)) for i in ids])
            there = np.zeros(1 << (64 - int(_SHIFT)), bool)
            there[keys >> _SHIFT] = True
            own = _points([self.text[i] for i in ids[order]], size)
            self.tables[size] = keys[order], ids[order].astype(np.int32), scores[order], there, own
        self.scored = {self.text[i]: (i, m.get_score(i)) for i in plain}
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        """Rolling hashes of each row's prefixes, the empty one first; a prefix
        length is a row of the result."""
        sign = _signs(points).T.copy()
        out = np.zeros((points.shape[1] + 1, len(points)), np.uint64)
        for j in range(points.shape[1]):
            np.multiply(out[j], _BASE, out=out[j + 1])
            out[j + 1] += sign[j]
        return out

    def _viterbi(self, words: list[str], length: int) -> np.ndarray:
        """Piece that ends at each position of each word on the best path, -1
        where none ends, -2 for a character without a piece. A bitmap of the
        keys' leading bits spares most substrings the search."""
        n = len(words)
        points = _points(words, length)
        prefix = self._prefix(points)
        power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        best = np.zeros((length + 1, n))
        piece = np.full((length + 1, n), -2, np.int32)
        back = np.ones((length + 1, n), np.int32)
        for j in range(1, length + 1):
            top = best[j]
            np.add(best[j - 1], self.unknown, out=top)
            for size in range(min(j, self.longest), 0, -1):
                if size not in self.tables:
                    continue
                keys, numbers, scores, there, own = self.tables[size]
                want = prefix[j] - prefix[j - size] * power[size]
                rows = np.flatnonzero(there[want >> _SHIFT])
                if not len(rows):
                    continue
                want = want[rows]
                at = np.searchsorted(keys, want)
                at[at == len(keys)] = 0
                hit = keys[at] == want
                rows, at = rows[hit], at[hit]
                same = (points[rows, j - size : j] == own[at]).all(1)
                if not same.all():
                    rows, at = rows[same], at[same]
                score = best[j - size][rows] + scores[at]
                better = score > top[rows]
                rows, at = rows[better], at[better]
                top[rows] = score[better]
                piece[j, rows] = numbers[at]
                back[j, rows] = size
        used = np.zeros((length + 1, n), bool)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            used[at, rows] = True
            at = at - back[at, rows]
            going = at > 0
            rows, at = rows[going], at[going]
        piece[~used] = -1
        return np.ascontiguousarray(piece[1:].T)

    def _lone(self, word: str) -> np.ndarray:
        """_viterbi() of one long word, by its substrings themselves: a step over
        an array of one word costs more than the steps of one."""
        n, scored, sizes = len(word), self.scored, sorted(self.tables, reverse=True)
        best, piece, back = [0.0] * (n + 1), [-2] * (n + 1), [1] * (n + 1)
        for j in range(1, n + 1):
            top = best[j - 1] + self.unknown
            for size in sizes:
                if size <= j and (found := scored.get(word[j - size : j])) is not None:
                    score = best[j - size] + found[1]
                    if score > top:
                        top, piece[j], back[j] = score, found[0], size
            best[j] = top
        out, at = np.full(n, -1, np.int32), n
        while at > 0:
            out[at - 1] = piece[at]
            at -= back[at]
        return out[None]

    def _segment(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, min(GROUP, 2_000_000 // length)) if length <= LONE else 1
            for k in range(0, len(group), step):
                part = group[k : k + step]
                piece = self._viterbi(part, length) if length <= LONE else self._lone(part[0])
                odd = (piece == -2).any(1)
                ends = np.cumsum((piece != -1).sum(1)) * 4
                raw = piece[piece != -1].astype("<i4").tobytes()
                begin = 0
                for w, end in zip(part, ends.tolist(), strict=True):
                    self.known[w] = raw[begin:end]
                    begin = end
                for i in np.flatnonzero(odd).tolist():
                    ids: list[int] = []
                    for c, p in zip(part[i], piece[i].tolist(), strict=True):
                        if p == -2:
                            ids += [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
                        elif p >= 0:
                            ids.append(p)
                    self.known[part[i]] = np.array(ids, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        rows, new = [], set()
        for t in texts:
            words = self.words(t)
            rows.append(words)
            new.update(words)
        self._segment([w for w in new if w not in self.known])
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in words]), "<i4") for words in rows]

    def words(self, text: str) -> list[str]:
        """The text's independent parts: words with the spaces before them, and
        line feeds if no piece holds one."""
        if not text:
            return []
        out: list[str] = []
        lines = text.replace(SPACE, " ").split("\n") if self.own_lines else [text.replace(SPACE, " ")]
        for k, line in enumerate(lines):
            parts = line.split(" ")
            if k:
                out.append("\n")
                if parts[0]:
                    out.append(parts[0])
                del parts[0]
            if "" not in parts:
                out += [SPACE + w for w in parts]
                continue
            run = 0
            for w in parts:
                run += 1
                if w:
                    out.append(SPACE * run + w)
                    run = 0
            if run:
                out.append(SPACE * run)
        return out

    def decode(self, ids) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.skip:
                out.append(self.text[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")[1:]

    @property
    def byte_of(self) -> dict[int, int]:
        if "_byte_of" not in self.__dict__:
            self._byte_of = {i: b for b, i in self.byte.items()}
        return self._byte_of

    def decode_batch(self, rows: list[np.ndarray]) -> list[str]:
        """decode() of each row; rows without byte pieces beyond ASCII are
        joined directly."""
        if "_table" not in self.__dict__:
            low = {i: chr(b) for i, b in self.byte_of.items() if b < 128}
            self._table = [low.get(i, "" if i in self.skip else t) for i, t in enumerate(self.text)]
            self._beyond = np.isin(np.arange(len(self.text)), [i for i, b in self.byte_of.items() if b > 127])
        table, out = self._table, []
        for ids in rows:
            if self._beyond[ids].any():
                out.append(self.decode(ids.tolist()))
            else:
                out.append("".join([table[i] for i in ids.tolist()]).replace(SPACE, " ")[1:])
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _chunks(texts: list[str]) -> Iterator[slice]:
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars > CHUNK_CHARS:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for s in _chunks(texts):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s], "ids": model.encode(texts[s])})

    return run


def _decode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for b in batches:
            rows = [np.zeros(0, np.int64) if x is None else np.asarray(x) for x in b["ids"]]
            yield b.assign(text=model.decode_batch(rows))

    return run


def _both(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(path)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for s in _chunks(texts):
                ids = model.encode(texts[s])
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[s], "ids": ids, "text": model.decode_batch(ids)})

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_id(rows.mapInPandas(_encode(path), "doc_id string, ids array<int>"), "doc_id")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) with text."""
    rows = encoded.select(id_text("doc_id").alias("doc_id"), "ids")
    return with_id(rows.mapInPandas(_decode(path), "doc_id string, ids array<int>, text string"), "doc_id")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) with one Python worker a task."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_id(rows.mapInPandas(_both(path), "doc_id string, ids array<int>, text string"), "doc_id")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece_viterbi(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = round_trip(table(spark, sf_dir, "documents"), default_model())
    return found.withColumn("n_tokens", F.size("ids").cast("long"))
