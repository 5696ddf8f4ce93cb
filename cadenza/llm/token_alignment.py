"""Alignment of two tokenizers' ids over the same texts, by distinct segments.

A text is cut before runs of white space, at the characters where neither
vocabulary can merge across (see cut_characters); so each segment's tokens are
the same alone as in the text. Tasks number the distinct segments of blocks of
documents. The rows (segment, block) are then dealt by segment and sorted: a
segment is tokenised and aligned once in the corpus, however many blocks hold it,
and each of its rows takes the alignment back to its block. A segment is in a
block's rows once, so none is hot. Blocks compose their documents from these.

An alignment is a list of groups: the shortest strings at whose end tokens of
both kinds end. All tokens of the two kinds in a group are linked. The number of
documents that hold an id pair linked is counted over blocks, and joined back to
the pairs of each block.

Texts that are null, empty, or whose tokens' bytes don't give " " + text (as with
U+2581 in a text) have no tokens: zeros. Rows with a repeated or null id are
documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize, partitions, with_id

#: Characters of the documents of one block.
BLOCK_CHARS = 10_000_000
#: Segments that are tokenised at a time.
BATCH = 4096
#: Rows of segments that leave a task together.
ROWS = 50_000
#: Segments, or documents, of a block that are composed at a time.
SLICE = 400_000
SLICE_DOCS = 4096
SPACE = "▁"
_WHITE = " \t\n\r\x0b\f"
#: A wider white space than either tokenizer's.
_ANY_SPACE = r"\s᠎"


# ---- where texts can be cut


def byte_level_cuts(spec: dict) -> bool:
    """Whether the byte-level tokenizer of this description begins a pre-token at
    each run of white space."""
    pre = spec.get("pre_tokenizer") or {}
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(level and not spec.get("normalizer") and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"))


def piece_cuts(proto) -> str:
    """The white-space characters before which the merging model of this
    description never has a piece that goes on from a character that isn't white
    space, and (but for the space itself) none that begins with the added space."""
    plain = proto.trainer_spec.model_type == 2 and proto.normalizer_spec.name == "identity" and proto.normalizer_spec.add_dummy_prefix
    own = [p.type for p in proto.pieces]
    if not plain or proto.normalizer_spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or 4 in own:  # 4: the user's own pieces
        return ""
    pieces = [p.piece for p in proto.pieces if p.type == 1]
    good = ""
    for c in _WHITE:
        mark = SPACE if c == " " else c
        across = any(b == mark and a != SPACE and not a.isspace() for p in pieces for a, b in zip(p, p[1:], strict=False))
        if not across and (c == " " or not any(SPACE + c in p for p in pieces)):
            good += c
    return good


def cut_characters(byte_level: str, piece_model: str) -> str:
    """The characters before whose runs texts can be cut for both tokenizers."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(Path(piece_model).read_bytes())
    spec = json.loads(Path(byte_level).read_text(encoding="utf-8"))
    found = piece_cuts(proto) if byte_level_cuts(spec) else ""
    return found if " " in found else ""


def splitter(cuts: str):
    """text -> its segments; uncut without characters to cut at."""
    if not cuts:
        return lambda text: [text]
    space, other = f"[{_ANY_SPACE}]", f"[^{_ANY_SPACE}]"
    find = re.compile(rf"{space}*+(?:{other}++(?:(?![{re.escape(cuts)}]){space}++)?+)*+").findall
    return lambda text: find(text)[:-1]  # the last match is the empty end


# ---- tokens of segments


class Pair:
    """Both tokenizers."""

    def __init__(self, byte_level: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        signs = byte_signs()
        self.a_bytes = {i: bytes(signs.get(c, 0) for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in signs for c in t)}
        b = self.b
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else None if b.is_control(i) or b.is_unknown(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(b.get_piece_size())]
        self.space = b.piece_to_id(SPACE)

    def _b_ids(self, segments: list[str]) -> list[list[int]]:
        """The model adds a space: it stands for a segment's own, else it goes."""
        own = [s.startswith(" ") for s in segments]
        ids = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        return [(x or [self.space]) if o else x[1:] for x, o in zip(ids, own, strict=True)]

    def align(self, segments: list[str]) -> list[list[tuple[list[int], list[int]]] | None]:
        """Groups of ids of each segment; None where bytes differ."""
        out = []
        for s, e, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self._b_ids(segments), strict=True):
            out.append(grouped(s.encode("utf-8", "surrogatepass"), e.ids, [self.a_bytes.get(i) for i in e.ids], b, [self.b_bytes[i] for i in b]))
        return out


@cache
def pair(byte_level: str, piece_model: str) -> Pair:
    return Pair(byte_level, piece_model)


def byte_signs() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the
    others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def grouped(text: bytes, a: list[int], a_bytes: list, b: list[int], b_bytes: list) -> list[tuple[list[int], list[int]]] | None:
    if None in a_bytes or None in b_bytes or b"".join(a_bytes) != text or b"".join(b_bytes) != text:
        return None
    out, i, j, begin_a, begin_b, end_a, end_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a += len(a_bytes[i])
            i += 1
        else:
            end_b += len(b_bytes[j])
            j += 1
        if end_a == end_b:
            out.append((a[begin_a:i], b[begin_b:j]))
            begin_a, begin_b = i, j
    return out


def encoded(groups: list[tuple[list[int], list[int]]] | None) -> list[int]:
    """The number of groups, their sizes, their ids; nothing for None."""
    if groups is None:
        return []
    return [len(groups), *(len(x) for g in groups for x in g), *(i for g in groups for x in g for i in x)]


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte by byte: the high ones are mostly zeros."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


# ---- blocks


_BLOCK = "block long, doc_id string, places binary, segment string, place int"


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = found = len(self)
        return found


def _blocks(cuts: str, chars: int):
    """Documents as the numbers of their segments in their block, and the block's
    distinct segments."""

    def flush(block: int, docs: list[tuple], numbers: _Numbers) -> Iterator[pd.DataFrame]:
        rows = [(block, doc, places, None, None) for doc, places in docs]
        yield pd.DataFrame(rows, columns=["block", "doc_id", "places", "segment", "place"])
        n = len(numbers)
        if n:
            yield pd.DataFrame({"block": block, "doc_id": None, "places": None, "segment": list(numbers), "place": np.arange(n, dtype=np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = splitter(cuts)
        block, held, docs, numbers = TaskContext.get().partitionId() << 32, 0, [], _Numbers()
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                parts = split(" " + text) if text else []
                places = np.fromiter(map(numbers.__getitem__, parts), np.uint32, len(parts))
                docs.append((doc, packed(places)))
                held += len(text or "")
                if held > chars:
                    yield from flush(block, docs, numbers)
                    block, held, docs, numbers = block + 1, 0, [], _Numbers()
        if docs:
            yield from flush(block, docs, numbers)

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[k] .. starts[k] + sizes[k] - 1, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


#: Of some of a block's segments: their places, their codes' lengths, their codes.
_CODES = "block long, places binary, sizes binary, codes binary"


def _aligned(byte_level: str, piece_model: str):
    """Rows (segment, block, place) come sorted by segment: the first of a
    segment is aligned, the others take its alignment. They leave together by
    block, as many as were read at a time."""

    def flush(flat: array, sizes: list[int], rows: list[tuple]) -> pd.DataFrame:
        codes, sizes = np.array(flat, np.int64), np.array(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        block, place, at = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        out = []
        for b, mine in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            k = at[mine]
            out.append((b, packed(place[mine]), packed(sizes[k]), packed(codes[_ranges(starts[k], sizes[k])])))
        return pd.DataFrame(out, columns=["block", "places", "sizes", "codes"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, last, code, held, rows = pair(byte_level, piece_model), None, [], 0, []
        flat, sizes = array("I"), []
        for b in batches:
            segments = b["segment"].to_numpy(object)
            if not len(segments):
                continue
            if not rows:
                flat, sizes = array("I", code), [len(code)]
            fresh = np.ones(len(segments), bool)
            fresh[1:] = segments[1:] != segments[:-1]
            fresh[0] = segments[0] != last
            new, known = segments[fresh].tolist(), len(sizes) - 1
            for k in range(0, len(new), BATCH):
                for groups in both.align(new[k : k + BATCH]):
                    code = encoded(groups)
                    flat.extend(code)
                    sizes.append(len(code))
            rows.append((b["block"].to_numpy(np.int64), b["place"].to_numpy(np.int64), known + np.cumsum(fresh)))
            last, held = segments[-1], held + len(segments)
            if held >= ROWS:
                yield flush(flat, sizes, rows)
                held, rows = 0, []
        if rows:
            yield flush(flat, sizes, rows)

    return run


#: Rows of documents (pairs: numbers of their block's pairs and how often each is
#: linked) and of a block's pairs (by number; documents that hold them).
_COMPOSED = (
    "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs binary, "
    "number long, pair long, documents long"
)
_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs"]


class _Alignments:
    """The codes of a block's segments, as arrays by place: numbers of ids and
    groups, the groups as text, and links as (place, pair's number, times)."""

    def __init__(self, parts: pd.DataFrame):
        place = np.concatenate([unpacked(x) for x in parts["places"]]) if len(parts) else np.zeros(0, np.int64)
        size = np.concatenate([unpacked(x) for x in parts["sizes"]]) if len(parts) else place
        flat = np.concatenate([unpacked(x) for x in parts["codes"]]) if len(parts) else place
        n = self.n = int(place.max()) + 1 if len(place) else 0
        self.bad = np.zeros(n, bool)
        self.bad[place[size == 0]] = True
        start = np.cumsum(size) - size
        place, start = place[size > 0], start[size > 0]
        groups = flat[start]
        both = flat[_ranges(start + 1, 2 * groups)].reshape(-1, 2)
        na, nb = both[:, 0], both[:, 1]
        owner = np.repeat(place, groups)
        self.figures = np.zeros((4, n), np.int64)
        for k, values in enumerate((na, nb, np.ones_like(na), na * nb)):
            self.figures[k] = np.bincount(owner, values, n)
        ids = np.cumsum(na + nb) - (na + nb)  # within all ids, in the codes' order
        of_ids = flat[_ranges(start + 1 + 2 * groups, self.figures[0][place] + self.figures[1][place])]
        inner = _ranges(np.zeros_like(na), na * nb)
        first, width = np.repeat(ids, na * nb), np.repeat(nb, na * nb)
        linked = of_ids[first + inner // width] << 32 | of_ids[first + np.repeat(na, na * nb) + inner % width]
        del inner, first, width, flat, both
        self.pairs, number = np.unique(linked, return_inverse=True)
        size = max(len(self.pairs), 1)
        keys, self.times = np.unique(np.repeat(owner, na * nb) * size + number, return_counts=True)
        del linked, number, owner
        self.number = keys % size
        self.starts = np.searchsorted(keys, np.arange(n + 1) * size)
        self.texts = [""] * n
        last, begin = np.cumsum(groups), 0
        for k in range(0, len(place), BATCH):
            end = int(last[min(k + BATCH, len(place)) - 1])
            low = int(ids[begin])
            said = list(map(str, of_ids[low : int(ids[end]) if end < len(ids) else None].tolist()))
            spans = zip((ids[begin:end] - low).tolist(), na[begin:end].tolist(), nb[begin:end].tolist(), strict=True)
            for p, count in zip(place[k : k + BATCH].tolist(), groups[k : k + BATCH].tolist(), strict=True):
                told = [f"{said[i]}|{said[i + 1]}" if x == y == 1 else f"{','.join(said[i : i + x])}|{','.join(said[i + x : i + x + y])}" for i, x, y in islice(spans, count)]
                self.texts[p] = ";".join(told)
            begin = end


def _composed(keep_groups: bool):
    """One block: its documents' rows and its pairs'."""

    def run(docs: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        known = _Alignments(codes)
        rows, documents, held, size = [], np.zeros(len(known.pairs), np.int64), [], 0
        for doc, raw in zip(docs["doc_id"], docs["places"], strict=True):
            p = unpacked(raw)
            held.append((doc, p if not known.bad[p].any() else p[:0]))
            size += len(p)
            if size > SLICE or len(held) >= SLICE_DOCS:
                rows += some(known, held, documents)
                held, size = [], 0
        rows += some(known, held, documents)
        used = np.flatnonzero(documents)
        nothing = [None] * len(_DOC)
        rows += [(*nothing, *x) for x in zip(used.tolist(), known.pairs[used].tolist(), documents[used].tolist(), strict=True)]
        out = pd.DataFrame(rows, columns=[*_DOC, "number", "pair", "documents"], dtype=object)
        out.insert(0, "block", int(docs["block"].iloc[0]) if len(docs) else int(codes["block"].iloc[0]))
        return out

    def some(known: _Alignments, docs: list[tuple], documents: np.ndarray) -> list[tuple]:
        """Rows of some documents; the pairs' numbers of documents grow."""
        n, n_pairs, places = max(known.n, 1), max(len(known.pairs), 1), [p for _, p in docs]
        owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
        flat = np.concatenate(places) if places else np.zeros(0, np.int64)
        seen, often = np.unique(owner * n + flat, return_counts=True)
        owner, flat = seen // n, seen % n
        total = [np.bincount(owner, f[flat] * often, len(places)).astype(np.int64) for f in known.figures]
        sizes = known.starts[flat + 1] - known.starts[flat]
        at = _ranges(known.starts[flat], sizes)
        keys = np.repeat(owner, sizes) * n_pairs + known.number[at]
        weights = np.repeat(often, sizes) * known.times[at]
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
        held, weights = keys[first], np.add.reduceat(weights, first) if len(first) else weights
        number = held % n_pairs
        bounds = np.searchsorted(held, np.arange(len(places) + 1) * n_pairs).tolist()
        texts, rows = known.texts, []
        for k, (doc, p) in enumerate(docs):
            text = ";".join([texts[i] for i in p.tolist()])
            mine = slice(bounds[k], bounds[k + 1])
            links = packed(np.concatenate((np.diff(number[mine], prepend=0), weights[mine])))
            rows.append((doc, *(int(t[k]) for t in total), text if keep_groups else None, hashlib.sha256(text.encode()).hexdigest() if text else "", links, None, None, None))
        documents += np.bincount(number, minlength=len(documents))
        return rows

    return run


_RESULT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def _totalled(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """One block's documents with the sums over their links."""
    size = int(pairs["number"].max()) + 1 if len(pairs) else 0
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    number = pairs["number"].to_numpy(np.int64)
    count[number], best[number] = pairs["count"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
    sums = []
    for raw in docs["pairs"]:
        steps, weight = np.split(unpacked(raw), 2)
        at = np.cumsum(steps)
        sums.append((int((best[at] * weight).sum()), int((count[at] * weight).sum())))
    n_best, count_sum = np.array(sums, np.int64).reshape(-1, 2).T
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256"]]
    return out.assign(n_best=n_best, count_sum=count_sum)[[c.split()[0] for c in _RESULT.split(", ")]]


def align(docs: DataFrame, byte_level: str, piece_model: str, keep_groups: bool = True, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """_RESULT, one row per row of docs, whose text is taken with a space before
    it. n_a and n_b: tokens; n_groups and n_links: groups, and pairs of tokens in
    the same group; count_sum: over links, how many documents hold their id pair
    linked; n_best: links of which this is the highest for their first id;
    groups: "a1,a2|b1;a3|b2", null without keep_groups."""
    spark = docs.sparkSession
    cuts = cut_characters(byte_level, piece_model)
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(rows.mapInPandas(_blocks(cuts, block_chars), _BLOCK), "alignment-blocks")
    segments = blocks.filter("segment is not null").select("segment", "block", "place")
    ordered = segments.repartition(partitions(spark), "segment").sortWithinPartitions("segment")
    codes = ordered.mapInPandas(_aligned(byte_level, piece_model), _CODES)
    of_docs = blocks.filter("segment is null").select("block", "doc_id", "places")
    both = of_docs.groupBy("block").cogroup(codes.groupBy("block"))
    composed = materialize(both.applyInPandas(_composed(keep_groups), _COMPOSED), "alignment-composed")
    discard(blocks)
    pairs = composed.filter("pair is not null").select("block", "number", "pair", "documents")
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("count"))
    counts = materialize(counts, "alignment-counts").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = pairs.join(judged, "pair").select(F.col("block").alias("of_block"), "number", "count", "best")
    again = composed.filter("pair is null").select("block", *_DOC)
    found = again.groupBy("block").cogroup(told.groupBy("of_block")).applyInPandas(_totalled, _RESULT)
    return with_id(found, "doc_id")


def op12_segment_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    path = public_tokenizers.path
    found = align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), keep_groups=False)
    return found.drop("groups")
