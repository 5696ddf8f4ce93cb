"""Language-model scores by an interpolated modified Kneser-Ney n-gram model.

Counting. Tasks count the n-grams of a bounded number of words at a time and
deal them, summed, to shards by their hash; so no shard is hot, whatever word is
frequent. A shard sums its n-grams and passes on, summed again, what the order
below needs of each distinct n-gram: its first words are a context of one more
follower (its count and whether that is one, two or more), its last words have
one more predecessor. So the orders are counted one after the other; from each a
few numbers (counts of counts) reach the driver.

Model. A shard's n-grams are written to the shared folder as arrays sorted by
64-bit hash: hashes, and one byte a number, with the larger ones beside them. A
file appears under its name when it is whole, so tasks can be run again.

Scoring. Workers map the files into memory (where the folder is a local or
mounted file system; else they read one shard at a time) and look the sorted
distinct n-grams of a few million words up, each file once and in its order.

A text is its words (lower-case A to Z, split at ASCII white space) and one end;
before it stand order - 1 begin marks, which are never predicted. A null text is
empty. Hashes of 64 bits stand for n-grams: 10^9 distinct ones of an order have
collisions with a probability of 3 %, and each changes one count.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize, scratch, with_id

ORDER = 2
#: Words that a task counts or scores at a time.
CHUNK = 1_500_000
#: Bytes of training text for each shard of an order.
SHARD_BYTES = 6 << 20
SEED = 42
#: Marks stand outside of words, which hold no spaces.
BEGIN, END = b" begin", b" end"
#: Of a k-gram: count (of the highest order) or number of different words before
#: it, sum of these over the n-grams that it begins, how many of these have one,
#: two, more; at order 1 the plain count too.
COUNT, SUM, ONE, TWO, MORE, PLAIN = range(6)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def joined(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of all words but the last, and the last."""
    x = (head ^ (head >> np.uint64(32))) * _MIX + word
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def gram_keys(words: np.ndarray) -> np.ndarray:
    key = words[0]
    for w in words[1:]:
        key = joined(key, w)
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys: shards in order hold keys in order."""
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


class _Ids(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


class _Chunk:
    """Texts as numbers of their distinct words."""

    def __init__(self, order: int):
        self.pads = [0] * (order - 1)
        self.ids = _Ids({BEGIN: 0, END: 1})
        self.tokens: list[int] = []

    def add(self, text: str | None) -> int:
        words = words_of(text)
        self.tokens += self.pads
        self.tokens += map(self.ids.__getitem__, words)
        self.tokens.append(1)
        return len(words) + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct words, and the tokens."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in self.ids), np.uint64, len(self.ids))
        return hashes, np.array(self.tokens, np.int64)


def _blob(columns: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(columns, np.uint64).tobytes(), 1)


def _columns(blobs, count: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint64).reshape(count, -1) for x in blobs], axis=1)


_PART = "level int, shard int, blob binary, totals array<long>"


def _dealt(level: int, shards: int, words: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    """Rows of _PART: n-grams (a row of words a column) with values, by shard."""
    shard = shard_of(gram_keys(words), shards).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    both = np.concatenate((words, values))[:, order]
    found, starts = np.unique(shard[order], return_index=True)
    for s, part in zip(found.tolist(), np.split(both, starts[1:], axis=1), strict=True):
        yield level, s, _blob(part), None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["level", "shard", "blob", "totals"])


def distinct_rows(columns: list[np.ndarray], bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct row of numbers below `bound`, and
    how often each occurs."""
    code, base = columns[0], bound
    for c in columns[1:]:
        if base > (1 << 62) // bound:
            _, code = np.unique(code, return_inverse=True)
            base = len(code)
        code, base = code * bound + c, base * bound
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, count


def _count(order: int, shards: int, chunk_words: int):
    def flush(chunk: _Chunk) -> pd.DataFrame:
        hashes, tokens = chunk.arrays()
        grams = [tokens[k : len(tokens) - order + 1 + k] for k in range(order)]
        grams = [g[grams[-1] != 0] for g in grams]
        first, count = distinct_rows(grams, len(hashes))
        rows = list(_dealt(order, shards, np.stack([hashes[g[first]] for g in grams]), count[None].astype(np.uint64)))
        plain = np.zeros((6, len(hashes)), np.uint64)
        plain[PLAIN] = np.bincount(tokens, minlength=len(hashes))
        return _frame(rows + list(_dealt(1, shards, hashes[None, 1:], plain[:, 1:])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = _Chunk(order)
        for b in batches:
            for text in b["text"]:
                chunk.add(text)
                if len(chunk.tokens) > chunk_words:
                    yield flush(chunk)
                    chunk = _Chunk(order)
        if chunk.tokens:
            yield flush(chunk)

    return run


def _summed(rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of words and values, those of one n-gram summed, by key; the keys."""
    keys = gram_keys(rows[:words])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    out = np.empty((len(rows), len(starts)), np.uint64)
    for k, row in enumerate(rows):
        out[k] = row[order[starts]] if k < words else np.add.reduceat(row[order], starts)
    return out, keys[starts]


# ---- files


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Keys in order; then of each row of values a byte each, and places and
    values of those that don't fit (byte 255). All parts begin at multiples of 8."""
    parts = [np.array([len(keys), len(values)], np.uint64), keys]
    for v in values:
        large = np.flatnonzero(v >= 255)
        small = np.zeros(-(-len(v) // 8) * 8, np.uint8)
        small[: len(v)] = np.minimum(v, 255)
        parts += [small, np.array([len(large)], np.uint64), large.astype(np.uint64), v[large]]
    store, path = _store(uri)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(aside) as out:
        for p in parts:
            out.write(p.tobytes())
    store.move(aside, path)


class Arrays:
    """One file of sorted hashes, mapped into memory where it lies on a file
    system."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        if store.type_name == "local":
            data = np.memmap(path, np.uint8, "r")
        else:
            with store.open_input_stream(path) as f:
                data = np.frombuffer(f.read(), np.uint8)
        n, rows = data[:16].view(np.uint64).tolist()
        self.keys, at = data[16 : 16 + 8 * n].view(np.uint64), 16 + 8 * n
        self.values = []
        for _ in range(rows):
            small, at = data[at : at + n], at + -(-n // 8) * 8
            m = int(data[at : at + 8].view(np.uint64)[0])
            large = data[at + 8 : at + 8 + 16 * m].view(np.uint64)
            self.values.append((small, large[:m], large[m:]))
            at += 8 + 16 * m

    def find(self, probes: np.ndarray, rows: list[int]) -> np.ndarray:
        """Of sorted probes the given rows of values, zeros for unknown keys."""
        out = np.zeros((len(rows), len(probes)), np.int64)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == probes)
        at = at[known]
        for k, row in enumerate(rows):
            small, places, values = self.values[row]
            found = small[at].astype(np.int64)
            large = np.flatnonzero(found == 255)
            if len(large):
                found[large] = values[np.searchsorted(places, at[large].astype(np.uint64))].astype(np.int64)
            out[k, known] = found
        return out


def _file(folder: str, level: int, shard: int) -> str:
    return f"{folder}/{level}-{shard:08d}"


def _sum_shard(folder: str, level: int, order: int, shards: int):
    """One shard of an order: its file, what the order below needs, totals. Of
    lower orders the numbers so far."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, shard = int(pdf["level"].iloc[0]), int(pdf["shard"].iloc[0])
        if own < level:
            rows, _ = _summed(_columns(pdf["blob"], own + 6), own)
            return _frame([(own, shard, _blob(rows), None)])
        width = 1 if level == order else 6
        rows, keys = _summed(_columns(pdf["blob"], level + width), level)
        words, values = rows[:level], rows[level:]
        write_arrays(_file(folder, level, shard), keys, values)
        count = values[COUNT]
        real = count > 0
        exact = [int((count == k).sum()) for k in (1, 2, 3, 4)]
        totals = [*exact, int(count.sum()), int(real.sum()), int(values[PLAIN].sum()) if level == 1 else 0]
        out = [(0, level, None, totals)]
        if level > 1:
            words, count = words[:, real], count[real]
            below = np.zeros((6, 2 * len(count)), np.uint64)
            head, tail = below[:, : len(count)], below[:, len(count) :]
            head[SUM], head[ONE], head[TWO], head[MORE] = count, count == 1, count == 2, count > 2
            tail[COUNT] = 1
            next_rows, _ = _summed(np.concatenate((np.concatenate((words[:-1], words[1:]), axis=1), below)), level - 1)
            out += _dealt(level - 1, shards, next_rows[: level - 1], next_rows[level - 1 :])
        return _frame(out)

    return run


# ---- the model


@dataclass(frozen=True)
class Model:
    """Files by order and shard in `folder`; discounts[k] are order k's for
    counts of one, two and more; of order 1 the sum of counts and the numbers of
    words with one, two, more; the plain number of tokens and of distinct ones."""

    folder: str
    order: int
    shards: int
    discounts: dict[int, tuple[float, float, float]]
    unigrams: tuple[int, int, int, int]
    tokens: int
    distinct: int


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams with counts of 1
    to 4; where one is missing or a discount is out of range, fixed values."""
    n1, n2, n3, n4 = counts
    if min(counts) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def train(texts: DataFrame, order: int = ORDER, text_col: str = "text", chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES) -> Model | None:
    """The model of all rows' texts, of order 2 or more; None without rows."""
    spark = texts.sparkSession
    rows = texts.select(F.col(text_col).alias("text"))
    found = rows.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("decimal(38,0)"))).first()
    if not found[0]:
        return None
    shards = max(1, math.ceil(int(found[1] or 0) / shard_bytes))
    folder = scratch(spark, "lm-model")
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    parts, held, totals = rows.mapInPandas(_count(order, shards, chunk), _PART), [], {}
    for level in range(order, 0, -1):
        done = parts.filter("level > 0").groupBy("level", "shard").applyInPandas(_sum_shard(folder, level, order, shards), _PART)
        now = materialize(done, "lm-counts")
        sums = now.filter("level = 0").agg(*[F.sum(F.get("totals", k)).alias(f"t{k}") for k in range(7)]).first()
        totals[level] = [int(x or 0) for x in sums]
        held.append(now)
        parts = now
    for df in held:
        discard(df)
    n1, n2, _, _, total, distinct, tokens = totals[1]
    return Model(folder, order, shards, {k: discounts(t[:4]) for k, t in totals.items()}, (total, n1, n2, distinct - n1 - n2), tokens, distinct)


class Scorer:
    def __init__(self, model: Model):
        self.model = model

    def _arrays(self, level: int, shard: int) -> Arrays | None:
        from pyarrow import fs

        uri = _file(self.model.folder, level, shard)
        store, path = _store(uri)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None  # no n-gram of the order fell there
        return Arrays(uri)

    def look_up(self, level: int, keys: np.ndarray, rows: list[int]) -> np.ndarray:
        """Values of any keys: each file once, in order."""
        probes, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros((len(rows), len(probes)), np.int64)
        shard = shard_of(probes, self.model.shards).astype(np.int64)
        found, starts = np.unique(shard, return_index=True)
        for s, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(probes)], strict=True):
            arrays = self._arrays(level, s)
            if arrays is not None:
                out[:, a:b] = arrays.find(probes[a:b], rows)
        return out[:, inverse]

    def _share(self, level: int, count: np.ndarray, context, below: np.ndarray) -> np.ndarray:
        """Probability of words from their counts after contexts with given
        sums and numbers of followers, and from the order below."""
        cut = np.array([0.0, *self.model.discounts[level]])
        total, one, two, more = context
        own = np.maximum(count - cut[np.minimum(count, 3)], 0)
        left = cut[1] * one + cut[2] * two + cut[3] * more
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(total > 0, (own + left * below) / total, below)

    def score(self, hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, where it isn't a begin mark: its plain count, the base
        score and the model's, in log10."""
        m = self.model
        words = self.look_up(1, hashes, [COUNT, SUM, ONE, TWO, MORE, PLAIN])
        at = np.flatnonzero(tokens)
        p = self._share(1, words[COUNT][tokens[at]], m.unigrams, np.full(len(at), 1 / (m.distinct + 1)))
        heads = hashes[tokens]  # of the words up to here: the last one, two, ...
        contexts = words[SUM : MORE + 1][:, tokens]
        for level in range(2, m.order + 1):
            before = np.maximum(at - 1, 0)
            keys = joined(heads[before], hashes[tokens[at]])
            last = level == m.order
            found = self.look_up(level, keys, [COUNT] if last else [COUNT, SUM, ONE, TWO, MORE])
            p = self._share(level, found[0], contexts[:, before], p)
            if not last:  # begin marks' own n-grams: only as contexts
                longer = np.zeros(len(tokens), np.uint64)
                longer[1:] = joined(heads[:-1], hashes[tokens[1:]])
                marks = np.flatnonzero(tokens == 0)
                contexts = np.zeros((4, len(tokens)), np.int64)
                contexts[:, at] = found[1:]
                contexts[:, marks] = self.look_up(level, longer[marks], [SUM, ONE, TWO, MORE])
                heads = longer
        plain = words[PLAIN][tokens[at]]
        base = np.log10((plain + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
        return plain, base, np.log10(p)


SCHEMA = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model, chunk_words: int):
    def flush(scorer: Scorer, chunk: _Chunk, docs: list[tuple]) -> pd.DataFrame:
        sizes = np.array([d[2] for d in docs], np.int64)
        starts = np.cumsum(sizes) - sizes
        plain, base, score = scorer.score(*chunk.arrays())
        sums = [np.add.reduceat(x, starts) for x in ((plain > 0).astype(np.int64), base, score)]
        ids, outs = zip(*[d[:2] for d in docs], strict=True)
        return pd.DataFrame({"doc_id": list(ids), "held_out": list(outs), "n_tokens": sizes, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, chunk, docs = Scorer(model), _Chunk(model.order), []
        for b in batches:
            for doc, out, text in zip(b["doc_id"], b["held_out"], b["text"], strict=True):
                docs.append((doc, out, chunk.add(text)))
                if len(chunk.tokens) > chunk_words:
                    yield flush(scorer, chunk, docs)
                    chunk, docs = _Chunk(model.order), []
        if docs:
            yield flush(scorer, chunk, docs)

    return run


def scored(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: n_tokens (words and the end), n_known of them in
    the training tokens, base_score (add-half unigrams) and score, both log10
    probabilities of the whole text."""
    rows = docs.select(id_text(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return with_id(rows.mapInPandas(_score(model, chunk), SCHEMA), "doc_id")


def perplexity(score: Column, n_tokens: Column) -> Column:
    """Of a text, or of sums over texts."""
    return F.pow(F.lit(10.0), -score / n_tokens)


def scores(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that aren't held out, score all rows. Without training
    rows every token is unknown: the base is 1 over one word, and both scores
    are 0."""
    model = train(docs.filter(~held_out), order, text_col)
    if model is None:
        n = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long") + 1
        none = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.alias("held_out"), n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"))
        return none.withColumns({"train_tokens": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)})
    return scored(docs, model, held_out, id_col, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def every_fifth(id_col: str = "doc_id") -> Column:
    """The query's contract: held out by the id's checksum; a null id trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op11_kneser_ney_scores(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = scores(table(spark, sf_dir, "documents"), every_fifth())
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
