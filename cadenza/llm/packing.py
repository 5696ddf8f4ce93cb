"""Packing by concatenate-and-cut.

Pass one tokenizes each document once, in its own partition, and stores its ids
with the number of tokens before it in that partition. The partitions' totals
(one long a partition) become global offsets by a prefix sum. Pass two is a map:
a document's place in the endless token row is its partition's offset plus its
own, and fixed windows are cut out of that row. Nothing is shuffled; a document
of any length is cut freely. Only the last sequence can be short.

A null text is empty, and its document is the separator alone. Rows with a
repeated or null id are documents of their own.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, with_id

LENGTH = 1024
SEPARATOR = 0
#: Parts of texts in one of a worker's two cache generations.
CACHE_PARTS = 200_000
CHUNK_CHARS = 1_000_000
#: The byte-level pre-tokenizer's pattern on ASCII text (a fixed value of that format).
_LEVEL = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_ASCII_LEVEL = re.compile(_LEVEL, re.A)
#: Letters of the Latin, Greek and Cyrillic blocks, which all versions of Unicode in use agree on.
_LETTER = "A-Za-z" + "".join(c for c in map(chr, range(0x80, 0x530)) if c.isalpha())
#: The same with runs of such letters; what begins otherwise and has other characters goes up to white space.
_MIXED_LEVEL = re.compile(rf" ?[{_LETTER}]++(?![^\x00-\x7f])| ?[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f]\S*|{_LEVEL}", re.A)
_LETTERS = re.compile(f" ?[{_LETTER}]+")
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_of_sign() -> dict[str, int]:
    """The byte-level vocabulary's signs: printable bytes stand for themselves,
    the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level with no normalizer, prefix space
    or dropout, so that parts of a text can be tokenized apart."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return level and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")


class Encoder:
    """Ids of whole texts as bytes, all made by the tokenizers library. A text
    is cut where a pre-token begins: ASCII and plain letters into single
    pre-tokens, which the library's model tokenizes, the rest at white space,
    and that goes through the whole tokenizer; each distinct part once. A text with an added
    token's string or with white space beyond ASCII goes through it uncut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = _plain(spec)
        self.sign = {b: c for c, b in _byte_of_sign().items()}
        self.code = "H" if self.model.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known: list[dict[str, bytes]] = [{}, {}]

    def forget(self) -> None:
        self.known = [{}, {}]

    def _whole(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """The cache, with the ids of all these parts of texts."""
        if len(self.known[0]) > CACHE_PARTS:
            self.known = [{}, self.known[0]]
        known, old = self.known
        new = parts.difference(known)
        one, sign, code, letters = self.model.model.tokenize, self.sign, self.code, _LETTERS.fullmatch
        beyond = []
        for p in new:
            if p in old:
                known[p] = old[p]
            elif p.isascii() or letters(p):
                known[p] = array(code, [t.id for t in one(p.encode().decode("latin-1").translate(sign))]).tobytes()
            else:
                beyond.append(p)
        known.update(zip(beyond, self._whole(beyond), strict=True))
        return known

    def _parts(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        if text.isascii():
            return _ASCII_LEVEL.findall(text)
        return None if _OTHER_SPACE.search(text) else _MIXED_LEVEL.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        rows = [self._parts(t) if self.plain else None for t in texts]
        known = self._learn(set(chain.from_iterable(r for r in rows if r)))
        whole = iter(self._whole([t for t, r in zip(texts, rows, strict=True) if r is None]))
        return [next(whole) if r is None else b"".join([known[p] for p in r]) for r in rows]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _chunks(texts: list[str]) -> Iterator[slice]:
    begin = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars > CHUNK_CHARS:
            yield slice(begin, i + 1)
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


_STORED = "doc_id string, part int, before long, n long, ids binary"


def _tokenize(path: str, separator: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([separator], model.kind).tobytes()
        for b in batches:
            texts = [t or "" for t in b["text"]]
            ids = [x + end for s in _chunks(texts) for x in model.encode(texts[s])]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // model.kind.itemsize
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pd.DataFrame({"doc_id": b["doc_id"], "part": part, "before": at, "n": n, "ids": ids})
        model.forget()  # workers are used again, by other operators too

    return run


_PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(offsets: dict[int, int], kind: str, length: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            at = b["before"].to_numpy(np.int64) + np.array([offsets[p] for p in b["part"]], np.int64)
            for doc, place, n, raw in zip(b["doc_id"], at.tolist(), b["n"].tolist(), b["ids"], strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                s = 0
                while s < n:
                    off = (place + s) % length
                    e = min(n, s + length - off)
                    piece = ids[s:e].tobytes()
                    row = (doc, s, e - s, zlib.crc32(piece), n, (place + s) // length, off)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if keep_ids else row)
                    s = e
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            out = pd.DataFrame(rows, columns=names + ["ids"] * keep_ids)
            yield out

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The boundary records: one row per piece of a document in a window of
    `length` tokens; with keep_ids also the piece's ids (array<int>)."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stored = materialize(rows.mapInPandas(_tokenize(tokenizer, separator), _STORED), "packing-ids")
    total, offsets = 0, {}
    for part, n in sorted(map(tuple, stored.groupBy("part").agg(F.sum("n")).collect())):
        offsets[part], total = total, total + n
    kind = encoder(tokenizer).kind.str
    pieces = stored.mapInPandas(_cut(offsets, kind, length, keep_ids), _PIECE + ", ids array<int>" * keep_ids)
    return with_id(pieces, "doc_id")


def sequences(pieces: DataFrame, length: int = LENGTH, padding: int = SEPARATOR) -> DataFrame:
    """(sequence_id, ids, n_tokens, doc_ids) from pack(keep_ids=True): windows
    of exactly `length` ids; the last is padded unless its size is a power of
    two."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    ids = F.flatten(F.col("p.ids"))
    n = F.size(ids)
    whole = F.log2(n) == F.floor(F.log2(n))
    pad = F.array_repeat(F.lit(padding), F.when(whole, 0).otherwise(F.lit(length) - n).cast("int"))
    return grouped.select("sequence_id", F.concat(ids, pad).alias("ids"), n.alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_concat_and_cut(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
