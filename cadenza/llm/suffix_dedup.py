"""Removal of repeated long strings through a logarithmic index family.

Every string of `length` bytes has one anchor: the place, within it, of the
32-byte string of least fingerprint (leftmost of equals). The fingerprint hangs on
those bytes alone, so equal strings have equal anchors at equal places wherever they
stand, and one anchor serves a run of neighbouring strings: the suffixes that begin
at anchors, about one in 85, stand for all. A batch's suffix array has these
suffixes in the order of their text, told apart by their first 32 bytes, which any
match shares: each such text with its number of suffixes and whether their
surroundings (all bytes of the run's strings) are unlike.

Suffix arrays are kept as levels of an index family: tables dealt by text to a fixed
number of buckets and sorted by it in each. A new batch's array is merge-scanned against each
existing level; texts met there, or twice in the batch, are the candidates for long
matches. Then it joins the family: two levels of one rank are merged to one of the
next, so n batches leave at most log2(n) + 1 levels and a suffix is rewritten log2(n)
times. Scans and merges are sort-merge joins bucket by bucket; only a new array is
shuffled.

A second reading of the texts takes only suffixes of candidate texts (a bitmap of
bounded size over their fingerprints, which lets a few others through, and only costs
work where it is too full). Where all surroundings are equal the whole run repeats;
where they differ, each distinct surrounding comes along once and every string in it
is looked up among those of its fingerprint, and compared byte by byte. Texts with
more than HOT distinct surroundings are not gathered: their strings are dealt out, each by itself,
under fingerprints of 128 bits. Equal surroundings are told by 128 bits too
(fingerprints of the 32 bytes and of the surroundings).

Texts are UTF-8, null is empty; matches never cross rows; equal rows repeat each
other wholly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, remove, scratch

LENGTH = 200
GRAM = 32
#: Batches that a table given at once is dealt to.
BATCHES = 4
HOT = 20_000
#: A bitmap's size, as a power of two: at least, at most (64 MB).
FILTER_BITS = (20, 29)
BLOCK = 16
BUFFER = 1 << 18
#: Bits of a place in a buffer, whatever its size; a longer text is cut to overlapping parts.
PLACE_BITS = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_ODD3 = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _ODD2
    x ^= x >> np.uint64(29)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _pair(a: np.ndarray, b: np.ndarray, odd: np.uint64 = _ODD) -> np.ndarray:
    x = a * odd
    x += b
    return _mix(x)


def fingerprints(data: np.ndarray, length: int, odd: np.uint64 = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """Of each GRAM-byte and each length-byte string of data, by doubling."""
    size, now, held, whole, at = 1, _BYTE[data], None, None, 0
    while True:
        if size == GRAM:
            held = now
        if length & size:
            n = len(data) - length + 1
            part = now[at : at + n]
            whole = part.copy() if whole is None else _pair(whole, part, odd)
            at += size
        if size * 2 > length:
            return held, whole
        now = _pair(now[:-size], now[size:], odd)
        size *= 2


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of GRAM bytes, as fingerprints() gives them."""
    now = _BYTE[grams]
    while now.shape[1] > 1:
        now = _pair(now[:, 0::2], now[:, 1::2])
    return np.ascontiguousarray(now[:, 0])


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The place of the least value by its high bits, leftmost of equals, in each
    window: a rule that hangs on the window's own values alone."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    best, width = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while width * 2 <= window:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if rest := window - width:
        best = np.minimum(best[:-rest], best[rest:])
    return best & low


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int):
    """(text number, anchor, first and last start of its run, key, surroundings)
    over texts data[begin:end] of `length` bytes or more, as arrays. Positions
    are in data."""
    gram, whole = fingerprints(data, length)
    best = _least(gram, length - GRAM + 1)
    sizes = end - begin - length + 1
    starts = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    place = best[starts].astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(edge[1:], len(place)) - 1
    p, a, b = place[edge], starts[edge], starts[last]
    text = np.searchsorted(begin, p, "right") - 1
    shape = ((p - a) << 9 | (p - b)).astype(np.uint64)
    around = _pair(_pair(whole[a], whole[b]), _mix(shape * _ODD))
    return text, p, a, b, gram[p].view(np.int64), around.view(np.int64)


def _buffers(texts: list, length: int, buffer: int, most: int = 1 << PLACE_BITS) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts long enough for a match, joined to buffers of some bytes: (text
    numbers, bytes, begins, ends, offsets in the text). A longer text is a buffer
    of its own, one beyond `most` bytes several, which share length - 1 bytes."""
    rows, raws, places, size = [], [], [], 0

    def joined():
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        end = np.cumsum(n)
        return rows, np.frombuffer(b"".join(raws), np.uint8), end - n, end, np.array(places)

    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - length + 1, most - length + 1):
            part = raw[at : at + most] if len(raw) > most else raw
            if size and size + len(part) > buffer:
                yield joined()
                rows, raws, places, size = [], [], [], 0
            rows.append(i)
            raws.append(part)
            places.append(at)
            size += len(part)
    if rows:
        yield joined()


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _index(length: int, buffer: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            batch = b.column("batch").to_numpy(zero_copy_only=False)
            for rows, data, begin, end, _ in _buffers(b.column("text").to_pylist(), length, buffer):
                text, p, _, _, _, around = anchors(data, begin, end, length)
                grams = data[p[:, None] + np.arange(GRAM)]
                yield pa.RecordBatch.from_arrays([pa.array(batch[np.array(rows)[text]], pa.int32()), _fixed(grams), pa.array(around)], ["batch", "gram", "around"])

    return run


def suffixes(texts: DataFrame, length: int = LENGTH, buffer: int = BUFFER) -> DataFrame:
    """(batch, gram, around) of the anchored suffixes of texts(batch, text)."""
    return texts.select(F.col("batch").cast("int"), "text").mapInArrow(_index(length, buffer), "batch int, gram binary, around long")


class SuffixIndex:
    """The index family under one folder; `levels` are (rank, table, folder)
    from large to small. State is written after each batch, so that open() goes
    on from the last one that was added whole."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets, self.batches = buckets or partitions(spark), 0
        self.levels: list[tuple[int, str, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        rows = spark.read.parquet(f"{path}/state").collect()
        batches = max(r["batches"] for r in rows)
        rows = sorted((r for r in rows if r["batches"] == batches), key=lambda r: -r["rank"])
        found = cls(spark, path, rows[0]["buckets"])
        found.batches = batches
        for r in rows:
            name = f"suffix_level_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {name} (gram BINARY, n BIGINT, low BIGINT, mixed BOOLEAN) USING parquet "
                f"CLUSTERED BY (gram) SORTED BY (gram) INTO {found.buckets} BUCKETS LOCATION '{r['folder']}'"
            )
            found.levels.append((r["rank"], name, r["folder"]))
        return found

    def _stored(self, level: DataFrame) -> tuple[str, str]:
        name = f"suffix_level_{uuid.uuid4().hex}"
        folder = f"{self.path}/{name}"
        level.write.bucketBy(self.buckets, "gram").sortBy("gram").option("path", folder).saveAsTable(name)
        return name, folder

    def _dropped(self, name: str, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, folder)

    def _joined(self, new: str, old: str, how: str) -> DataFrame:
        """Two levels side by side: gram, n, low, mixed of both."""
        a, b = self.spark.table(new).alias("a").hint("merge"), self.spark.table(old).alias("b")
        unlike = F.coalesce(F.col("a.mixed"), F.lit(False)) | F.coalesce(F.col("b.mixed"), F.lit(False)) | F.coalesce(F.col("a.low") != F.col("b.low"), F.lit(False))
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        both = a.join(b, F.col("a.gram") == F.col("b.gram"), how)
        return both.select(F.coalesce("a.gram", "b.gram").alias("gram"), n.alias("n"), F.least("a.low", "b.low").alias("low"), unlike.alias("mixed"))

    def add(self, batch: DataFrame, keep_state: bool = True) -> DataFrame:
        """Index a batch of suffixes (gram, around); returns (gram, n, mixed) of
        the texts that repeat in it or between it and what the index holds, n
        being the suffixes of the most populous level met with the batch's."""
        array = batch.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("low"), (F.min("around") != F.max("around")).alias("mixed"))
        name, folder = self._stored(array)
        met = self.spark.table(name).filter("n > 1").select("gram", "n", "mixed")
        for _, old, _ in self.levels:
            met = met.unionByName(self._joined(name, old, "inner").select("gram", "n", "mixed"))
        met = materialize(met, "suffix-met")
        rank, gone = 0, []
        while self.levels and self.levels[-1][0] == rank:
            _, old, where = self.levels.pop()
            gone += [(old, where), (name, folder)]
            (name, folder), rank = self._stored(self._joined(name, old, "full_outer")), rank + 1
        self.levels.append((rank, name, folder))
        self.batches += 1
        if keep_state:
            rows = [(self.batches, self.buckets, r, f) for r, _, f in self.levels]
            self.spark.createDataFrame(rows, "batches int, buckets int, rank int, folder string").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        for old in gone:
            self._dropped(*old)
        return met

    def drop(self) -> None:
        for _, name, folder in self.levels:
            self._dropped(name, folder)
        self.levels = []
        remove(self.spark, self.path)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            grams = np.frombuffer(b"".join(b.column("gram").to_pylist()), np.uint8).reshape(-1, GRAM)
            yield pa.RecordBatch.from_arrays([pa.array(gram_keys(grams).view(np.int64)), b.column("n"), b.column("mixed")], ["key", "n", "mixed"])


def bitmap_bits(n: int) -> int:
    """Bits, as a power, of a bitmap for n keys: 16 a key, within FILTER_BITS."""
    return min(max(FILTER_BITS), max(min(FILTER_BITS), (16 * n).bit_length()))


def _block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    words = np.zeros(1 << (BLOCK - 6), np.int64)
    words[pdf["word"].to_numpy(np.int64) & (len(words) - 1)] = pdf["mask"].to_numpy(np.int64)
    return pd.DataFrame({"block": [key[0]], "words": [words.tobytes()]})


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, two set for each key, put together on the executors; the
    driver gets 2**(bits - BLOCK) blocks of 2**BLOCK bits whatever the keys."""
    spots = F.array(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned("key", bits).bitwiseAND(F.lit((1 << bits) - 1)))
    one = keys.select(F.explode(spots).alias("spot"))
    word = F.shiftrightunsigned("spot", 6).alias("word")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))
    found = one.groupBy(word).agg(F.bit_or(mask).alias("mask")).withColumn("block", F.shiftrightunsigned("word", BLOCK - 6))
    out = np.zeros(1 << (bits - 6), np.int64)
    per = 1 << (BLOCK - 6)
    for row in found.groupBy("block").applyInPandas(_block, "block long, words binary").toLocalIterator():
        out[row["block"] * per : (row["block"] + 1) * per] = np.frombuffer(row["words"], np.int64)
    return out


def in_bitmap(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.view(np.uint64)
    low = np.uint64((1 << bits) - 1)
    hit = np.ones(len(k), bool)
    for spot in (k & low, (k >> np.uint64(bits)) & low):
        hit &= (words.view(np.uint64)[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return hit


_SUFFIX = "row binary, key long, around long, place int, head int, tail int, mixed boolean, body binary"


def _candidates(length: int, buffer: int, all_words, mixed_words, bits: int):
    """head, tail: from the anchor back to the first and the last start."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            row = part["row"].to_numpy()
            for rows, data, begin, end, offset in _buffers(part["text"].tolist(), length, buffer):
                text, p, a, b, key, around = anchors(data, begin, end, length)
                hit = np.flatnonzero(in_bitmap(all_words.value, key, bits))
                if not len(hit):
                    continue
                text, p, a, b, key, around = (x[hit] for x in (text, p, a, b, key, around))
                mixed = in_bitmap(mixed_words.value, key, bits)
                raw = data.tobytes()
                yield pd.DataFrame(
                    {
                        "row": row[np.array(rows)[text]],
                        "key": key,
                        "around": around,
                        "place": (p - begin[text] + offset[text]).astype(np.int32),
                        "head": (p - a).astype(np.int32),
                        "tail": (p - b).astype(np.int32),
                        "mixed": mixed,
                        "body": [raw[x : y + length] if m else None for x, y, m in zip(a.tolist(), b.tolist(), mixed.tolist(), strict=True)],
                    }
                )

    return run


def _strings(length: int, head: np.ndarray, tail: np.ndarray, data: np.ndarray, size: np.ndarray):
    """(surroundings' number, distance to the anchor, place in data) of every
    string of the surroundings, joined in data."""
    begin = np.cumsum(size) - size
    count = head - tail + 1
    owner = np.repeat(np.arange(len(size)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return owner, head[owner] - step, begin[owner] + step


def _marks(length: int, key: np.ndarray, owner: np.ndarray, back: np.ndarray, at: np.ndarray, data: np.ndarray, odd: np.uint64) -> np.ndarray:
    _, whole = fingerprints(data, length, odd)
    return _pair(_pair(whole[at], _mix(back.astype(np.uint64) * odd)), key.view(np.uint64)[owner], odd)


def repeated(data: np.ndarray, at: np.ndarray, mark: np.ndarray, length: int) -> np.ndarray:
    """Whether the string at each place is another's equal: those of equal mark
    are compared byte by byte."""
    order = np.argsort(mark, kind="stable")
    same = mark[order[1:]] == mark[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    twice, wrong = np.zeros(len(at), bool), []
    for k in range(0, len(left), 20_000):
        x, y = left[k : k + 20_000], right[k : k + 20_000]
        equal = (data[at[x][:, None] + np.arange(length)] == data[at[y][:, None] + np.arange(length)]).all(1)
        twice[x[equal]] = twice[y[equal]] = True
        wrong += mark[x[~equal]].tolist()
    for m in set(wrong):  # unlike strings of one mark: by their bytes
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(mark == m).tolist():
            seen.setdefault(data[at[i] : at[i] + length].tobytes(), []).append(i)
        for found in seen.values():
            twice[found] = len(found) > 1
    return twice


_RESOLVED = "key long, around long, first int, last int"


def _runs(key, around, owner, back) -> pd.DataFrame:
    """Neighbouring strings joined; rows come by owner and falling `back`."""
    edge = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (back[1:] != back[:-1] - 1))))
    last = np.append(edge[1:], len(owner)) - 1
    own = owner[edge]
    return pd.DataFrame({"key": key[own], "around": around[own], "first": back[edge], "last": back[last]})


def _resolve(length: int):
    """Distinct surroundings come by key; a row out is a run of repeated strings."""

    def settled(d: pd.DataFrame) -> pd.DataFrame:
        key, around, n = (d[c].to_numpy(np.int64) for c in ("key", "around", "n"))
        head, tail = d["head"].to_numpy(np.int64), d["tail"].to_numpy(np.int64)
        full = n > 1
        out = [pd.DataFrame({"key": key[full], "around": around[full], "first": head[full], "last": tail[full]})]
        shared = np.concatenate((key[1:] == key[:-1], [False]))
        shared[1:] |= shared[:-1].copy()
        pick = np.flatnonzero(shared & d["body"].notna().to_numpy())
        if len(pick):
            body = d["body"].to_numpy()[pick].tolist()
            data, size = np.frombuffer(b"".join(body), np.uint8), np.fromiter(map(len, body), np.int64, len(body))
            owner, back, at = _strings(length, head[pick], tail[pick], data, size)
            twice = repeated(data, at, _marks(length, key[pick], owner, back, at, data, _ODD), length) & ~full[pick][owner]
            if twice.any():
                out.append(_runs(key[pick], around[pick], owner[twice], back[twice]))
        return pd.concat(out, ignore_index=True)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            rows = part if held is None else pd.concat([held, part], ignore_index=True)
            keys = rows["key"].to_numpy(np.int64)
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            for k in range(0, last, _GROUPS):
                lo, hi = (int(np.searchsorted(keys, keys[x], "left")) if x < last else last for x in (k, k + _GROUPS))
                if lo < hi:
                    yield settled(rows.iloc[lo:hi])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield settled(held)

    return run


#: Surroundings that are resolved at a time, but for the last ones' key.
_GROUPS = 4000


def _spread(length: int):
    """Each string of each surrounding: (key, around, back, mark, mark2)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), 2000):
                d = part.iloc[k : k + 2000]
                key, around = d["key"].to_numpy(np.int64), d["around"].to_numpy(np.int64)
                body = d["body"].tolist()
                data, size = np.frombuffer(b"".join(body), np.uint8), np.fromiter(map(len, body), np.int64, len(body))
                owner, back, at = _strings(length, d["head"].to_numpy(np.int64), d["tail"].to_numpy(np.int64), data, size)
                marks = [_marks(length, key, owner, back, at, data, odd).view(np.int64) for odd in (_ODD, _ODD3)]
                yield pd.DataFrame({"key": key[owner], "around": around[owner], "back": back, "mark": marks[0], "mark2": marks[1]})

    return run


def _classes(found: DataFrame) -> DataFrame:
    first = lambda c: F.first(c).alias(c)
    return found.groupBy("key", "around").agg(F.count("*").alias("n"), first("head"), first("tail"), first("body"))


def _hot_runs(classes: DataFrame, length: int) -> DataFrame:
    whole = classes.filter("n > 1").select("key", "around", F.col("head").alias("first"), F.col("tail").alias("last"))
    strings = classes.select("key", "around", "head", "tail", "body").mapInPandas(_spread(length), "key long, around long, back int, mark long, mark2 long")
    strings = materialize(strings, "suffix-strings")
    twice = materialize(strings.groupBy("mark", "mark2").agg(F.count("*").alias("n")).filter("n > 1").select("mark", "mark2"), "suffix-twice")
    found = strings.join(twice, ["mark", "mark2"]).select("key", "around", F.col("back").alias("first"), F.col("back").alias("last"))
    done = materialize(whole.unionByName(found), "suffix-hot")
    discard(strings)
    discard(twice)
    return done


def repeated_runs(rows: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot: int = HOT, buffer: int = BUFFER) -> DataFrame:
    """(row, start, stop): byte runs of rows(row, text) that strings of `length`
    bytes occurring twice or more cover; runs may overlap."""
    spark = rows.sparkSession
    texts = rows.select(F.pmod(F.xxhash64("row"), F.lit(batches)).alias("batch"), "text")
    folder = scratch(spark, "suffix-batches")
    suffixes(texts, length, buffer).write.partitionBy("batch").parquet(folder)
    given = spark.read.schema("gram binary, around long, batch int").parquet(folder)
    index, met = SuffixIndex(spark, scratch(spark, "suffix-index")), []
    for k in range(batches):
        met.append(index.add(given.filter(F.col("batch") == k), keep_state=False))
    remove(spark, folder)
    index.drop()
    matches = met[0]
    for m in met[1:]:
        matches = matches.unionByName(m)
    matches = matches.groupBy("gram").agg(F.max("n").alias("n"), F.bool_or("mixed").alias("mixed"))
    matches = materialize(matches.mapInArrow(_keyed, "key long, n long, mixed boolean"), "suffix-matches")
    for m in met:
        discard(m)
    send = spark.sparkContext.broadcast
    bits = bitmap_bits(matches.count())
    words = [send(bitmap(m, bits)) for m in (matches, matches.filter("mixed"))]
    discard(matches)
    found = materialize(rows.select("row", "text").mapInPandas(_candidates(length, buffer, *words, bits), _SUFFIX), "suffix-found")
    for w in words:
        w.destroy()
    crowded = found.filter("mixed").select("key", "around").distinct().groupBy("key").count().filter(F.col("count") > hot).select("key")
    crowded = materialize(crowded, "suffix-crowded")
    some = not crowded.isEmpty()
    cold = found.join(crowded, "key", "left_anti") if some else found
    dealt = _classes(cold).repartition(partitions(spark), "key").sortWithinPartitions("key")
    runs = materialize(dealt.mapInPandas(_resolve(length), _RESOLVED), "suffix-resolved")
    if some:
        runs = runs.unionByName(_hot_runs(_classes(found.join(crowded, "key", "left_semi")), length))
    discard(crowded)
    joined = found.select("row", "key", "around", "place").join(runs, ["key", "around"])
    return joined.select("row", (F.col("place") - F.col("first")).alias("start"), (F.col("place") - F.col("last") + length).alias("stop"))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((int(x["start"]), int(x["stop"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _with_runs(docs: DataFrame, **options) -> DataFrame:
    """docs with its columns as one struct, text and the runs to remove."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{n}`") for n in names])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in names else F.lit("")
    text = F.col("text").cast("string")
    # 128 bits of a row's id and text; rows with the same are cut alike
    row = F.substring(F.unhex(F.sha2(F.concat(key, F.lit("|"), F.coalesce(text, F.lit(""))), 256)), 1, 16)
    rows = docs.select(whole.alias("own"), text.alias("text"), row.alias("row"))
    runs = repeated_runs(rows.select("row", "text"), **options).distinct()
    spans = runs.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    return rows.join(spans, "row", "left")


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text, runs in zip(b["text"], b["runs"], strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            spans = _merge(runs) if runs is not None else []
            at, keep = 0, []
            for s, e in spans:
                keep.append(raw[at:s])
                at = e
            keep = b"".join([*keep, raw[at:]])
            left = None if text is None else text if not spans else keep.decode("utf-8", "ignore")
            rows.append((len(raw), len(raw) - len(keep), len(spans), hashlib.sha256(keep).hexdigest(), left))
        cut = pd.DataFrame(rows, columns=[c.split()[0] for c in _CUT.split(", ")], index=b.index)
        yield pd.concat([b[["own"]], cut], axis=1)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: own (its columns, a struct), n_bytes, n_removed,
    n_spans, kept_sha256 and kept, the text without the removed bytes (a
    character cut in two goes whole; null stays null)."""
    found = _with_runs(docs, **options).select("own", "text", "runs")
    return found.mapInPandas(_cut, f"own {found.schema['own'].dataType.simpleString()}, {_CUT}")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs, same columns, with the repeated bytes gone from text."""
    cut = remove_repeats(docs, **options)
    return cut.select(*[F.col("kept").alias(n) if n == "text" else F.col("own").getField(n).alias(n) for n in docs.columns])


def op6_suffix_levels(spark, sf_dir: str) -> DataFrame:
    from .common import table

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(F.col("own.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
