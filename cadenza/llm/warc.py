"""WARC: a deterministic sharded writer and a verifying reader.

Records are range-sorted by page id and payload digest. The ids' range is cut
into even slots whose payload bytes are counted; a slot with more than a shard's
bytes is cut again, over the ids that it really holds, then over the digests of
its one id, until every slot fits (an outlying id costs one more cut). Slots are
gathered, in order, to shards of a target size, so the shards depend on the rows
alone and not on sampling or partitioning; only rows equal in id and payload that
are more than a shard by themselves are dealt out by their place in the input.
A task writes a shard and rolls its files by compressed size, each record a
gzip member of its own. Headers, lengths and digests are regenerated. A file is
written under a temporary name that holds the task attempt; the manifest, a
Parquet table with Spark's own commit, lists the files of the attempts that
won, and only those are renamed, then what other attempts left is removed.
Renaming is idempotent, so a lost executor costs a repeat and never a torn
archive.

Of records with equal payloads of `least` bytes or more, those with the
smallest page id are responses and the others revisit it. A null html is an
empty payload. Repeated rows are records of their own (rows that share the
smallest id are all responses). A null page id is written and comes back null;
it never counts as the smallest unless its payload has no other.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions, prepare, scratch, with_id

#: Slots of the first cut and, at most, of one further cut.
SLOTS = 4096
#: A shard's payload bytes: this part of all, within these bounds.
SHARD_PART = 256
SHARD_BYTES = (4 << 20, 1 << 30)
ROLL_BYTES = 32 << 20
SALTS = 64
DATE = "1970-01-01T00:00:00Z"
_HEAD = b"WARC/1.1\r\n"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str, copy: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}:{copy}>"


def record(page_id: int | None, copy: str, url: str | None, payload: bytes, refers_to: int | None, first: bool) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit's block is the HTTP head
    alone, whose Content-Length is the full payload's. `copy` tells rows of
    equal id and payload apart."""
    digest = b32_sha1(payload)
    name = _name(page_id, digest, copy)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    fields = [("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        clean = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
        fields.append(("WARC-Target-URI", clean))
    if not first:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", _name(refers_to, digest, "0")))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{b32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return _HEAD + head + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


_MANIFEST = "shard long, roll int, tmp string, name string, records long, size long, sha256 string"


def _write(target: str, roll_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(target)
        attempt, done, out = uuid.uuid4().hex, [], None
        shard = roll = -1
        refers: tuple | None = None
        last, copies = None, 0

        def close():
            nonlocal out
            if out is not None:
                out[0].close()
                done.append((shard, roll, out[1], f"{path}/shard-{shard:06d}-{roll:05d}.warc.gz", out[3], out[2], out[4].hexdigest()))
                out = None

        for b in batches:
            for row in b.itertuples(index=False):
                if row.shard != shard:
                    close()
                    shard, roll, last = row.shard, -1, None
                page = None if row.page_id is None else int(row.page_id)
                if row.kind == 0:
                    refers = (page, row.digest, int(row.refers_to))
                    continue
                first = refers is None or refers[:2] != (page, row.digest)
                copies = copies + 1 if last == (page, row.digest) else 0
                last = (page, row.digest)
                payload = (row.html or "").encode("utf-8", "surrogatepass")
                copy = f"{row.piece}.{copies}" if row.piece else str(copies)
                data = member(record(page, copy, row.url, payload, None if first else refers[2], first))
                if out is None:
                    roll += 1
                    name = f"{path}/tmp-{attempt}-{shard:06d}-{roll:05d}"
                    out = [store.open_output_stream(name), name, 0, 0, hashlib.sha256()]
                out[0].write(data)
                out[2] += len(data)
                out[3] += 1
                out[4].update(data)
                if out[2] >= roll_bytes:
                    close()
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in _MANIFEST.split(", ")])
                done.clear()
        close()
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in _MANIFEST.split(", ")])

    return run


def _rename(target: str):
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(target)
        for b in batches:
            for tmp, name in zip(b["tmp"], b["name"], strict=True):
                if store.get_file_info(tmp).type == fs.FileType.File:
                    store.move(tmp, name)
                elif store.get_file_info(name).type != fs.FileType.File:
                    raise FileNotFoundError(f"neither {tmp} nor {name} is there")
            yield b[["name"]]

    return run


def _refers(slim: DataFrame) -> DataFrame:
    """Revisits: (page_id, digest, refers_to). A payload's copies are many at
    worst; its groups are dealt out under SALTS salts."""
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 and refers_to is not null").select("digest", "refers_to")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(groups, ["digest", "salt"])
    return found.filter("page_id is null or page_id != refers_to").select("page_id", "digest", "refers_to").distinct()


@dataclass
class _Cut:
    """A range of ids (axis 0), of one id's digests (1) or of one id and
    digest's rows (2), cut into slots; kids has a slot's bytes or its own cut."""

    axis: int
    low: int
    width: int
    slots: int
    kids: dict = field(default_factory=dict)


def _cut(row, shard_bytes: int) -> _Cut:
    slots = min(SLOTS, max(2, -(-4 * row["n"] // shard_bytes)))
    for axis, low, high in ((0, row["p0"], row["p1"]), (1, row["d0"], row["d1"])):
        if low < high:
            return _Cut(axis, low, (high - low) // slots + 1, slots)
    return _Cut(2, 0, 1, min(row["rows"], -(-row["n"] // shard_bytes)))


def _extent() -> list:
    low = [F.min(c).alias(f"{c[0]}0") for c in ("pid", "dig")]
    return [F.sum("n").alias("n"), F.count("*").alias("rows"), *low, *[F.max(c).alias(f"{c[0]}1") for c in ("pid", "dig")]]


class ShardPlan:
    """Cuts of all rows to shards; `salted` has the (pid, dig, pieces) that are
    more than a shard by themselves."""

    def __init__(self, slim: DataFrame, shard_bytes: int):
        self.levels: list[list[_Cut]] = []
        self.shards, self.salted = 1, []
        whole = slim.agg(*_extent()).first()
        if whole["n"] is None or whole["n"] <= shard_bytes or whole["rows"] == 1:
            return
        level = [_cut(whole, shard_bytes)]
        now, spot = slim, F.lit(0)
        while level:
            self.levels.append(level)
            deeper: list[_Cut] = []
            base = [sum(c.slots for c in level[:k]) for k in range(len(level))]
            now = now.withColumn("spot", self._spot(spot, level, F.lit(0)))
            found = {r["spot"]: r for r in now.filter("spot is not null").groupBy("spot").agg(*_extent()).collect()}
            state: list[int | None] = [None] * (base[-1] + level[-1].slots)
            for c, b in zip(level, base, strict=True):
                for k in range(c.slots):
                    if c.axis == 2:
                        c.kids[k] = shard_bytes
                    elif (r := found.get(b + k)) is None:
                        continue
                    elif r["n"] <= shard_bytes or r["rows"] == 1:
                        c.kids[k] = r["n"]
                    else:
                        c.kids[k] = _cut(r, shard_bytes)
                        state[b + k] = len(deeper)
                        deeper.append(c.kids[k])
                        if c.kids[k].axis == 2:
                            self.salted.append((r["p0"], r["d0"], c.kids[k].slots))
            spot = F.element_at(F.lit(state).cast("array<int>"), F.col("spot").cast("int") + 1)
            level = deeper
        held = shard = 0
        self.leaf: dict[int, int] = {}

        def number(c: _Cut):
            nonlocal held, shard
            for k in sorted(c.kids):
                kid = c.kids[k]
                if isinstance(kid, _Cut):
                    number(kid)
                    continue
                if held and held + kid > shard_bytes:
                    held, shard = 0, shard + 1
                c.kids[k], held = -shard - 1, held + kid

        number(self.levels[0][0])
        self.shards = shard + 1

    @staticmethod
    def _spot(state, level: list[_Cut], salt):
        """The number of a row's slot among all slots of a level; `state` is the
        number of its cut, null if it has none."""
        base, at = [], 0
        for c in level:
            base.append(at)
            at += c.slots

        def of(values, kind: str, x):
            return F.element_at(F.lit([str(v) for v in values]).cast(f"array<{kind}>"), x + 1)

        def slot(x):
            axis = of([c.axis for c in level], "int", x)
            value = F.when(axis == 0, F.col("pid")).when(axis == 1, F.col("dig")).otherwise(salt.cast("long")).cast("decimal(20,0)")
            low, width = (of([getattr(c, name) for c in level], "decimal(20,0)", x) for name in ("low", "width"))
            k = F.floor((value - low) / width).cast("long")
            k = F.greatest(F.lit(0).cast("long"), F.least(k, of([c.slots - 1 for c in level], "long", x)))
            return F.when(x.isNotNull(), of(base, "long", x) + k)

        # a lambda evaluates the state once
        return F.element_at(F.transform(F.array(state.cast("int")), slot), 1)

    def place(self, rows: DataFrame) -> DataFrame:
        """rows(pid, dig, piece, ...) with the number of their shard."""
        rows = rows.withColumn("shard", F.lit(0).cast("long"))
        if not self.levels:
            return rows
        rows = rows.withColumn("cut", F.lit(0).cast("long"))
        for level in self.levels:
            to, deeper = [], 0
            for c in level:
                for k in range(c.slots):
                    kid = c.kids.get(k, -1)
                    to.append(deeper if isinstance(kid, _Cut) else kid)
                    deeper += isinstance(kid, _Cut)
            told = F.lit(to).cast("array<long>")
            rows = rows.withColumn("spot", self._spot(F.when(F.col("cut") >= 0, F.col("cut")), level, F.col("piece")))
            rows = rows.withColumn("cut", F.coalesce(F.element_at(told, F.col("spot").cast("int") + 1), F.col("cut")))
        return rows.withColumn("shard", -F.col("cut") - 1).drop("cut", "spot")


def shard_bytes_of(total: int) -> int:
    return min(max(total // SHARD_PART, SHARD_BYTES[0]), SHARD_BYTES[1])


def write_archives(pages: DataFrame, target: str, least: int = 0, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) under `target`, a folder that driver and
    executors share; returns the committed manifest."""
    spark = prepare(pages.sparkSession)
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumns({"digest": F.sha1(body), "n": F.octet_length(body).cast("long")})
    slim = materialize(rows.select("page_id", "digest", "n"), "warc-slim")
    lowest = slim.agg(F.coalesce(F.min("page_id"), F.lit(0).cast("long"))).first()[0]
    keyed = {"pid": F.coalesce("page_id", F.lit(lowest)), "dig": F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")}
    if shard_bytes is None:
        shard_bytes = shard_bytes_of(slim.agg(F.sum("n")).first()[0] or 0)
    plan = ShardPlan(slim.withColumns(keyed), shard_bytes)
    store, path = _store(target)
    store.create_dir(path, recursive=True)
    told = _refers(slim.filter(F.col("n") >= least)).select(
        "page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to"
    )
    whole = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    told, whole = told.withColumns(keyed), whole.withColumns(keyed)
    if plan.salted:
        pieces = F.broadcast(spark.createDataFrame(plan.salted, "pid long, dig long, pieces long"))
        told = told.join(pieces, ["pid", "dig"], "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)) - 1)))
        whole = whole.join(pieces, ["pid", "dig"], "left").withColumn("piece", F.pmod(F.monotonically_increasing_id(), F.coalesce("pieces", F.lit(1))))
        told, whole = told.drop("pieces"), whole.drop("pieces")
    else:
        told, whole = (d.withColumn("piece", F.lit(0).cast("long")) for d in (told, whole))
    order = ["shard", "page_id", "digest", "piece", "kind", "url"]
    n = min(plan.shards, max(SLOTS, 8 * partitions(spark)))
    dealt = plan.place(told.unionByName(whole)).drop("pid", "dig").repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(*order)
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    manifest = materialize(dealt.mapInPandas(_write(target, roll_bytes), _MANIFEST), "warc-manifest")
    discard(slim)
    manifest.select("tmp", "name").mapInPandas(_rename(target), "name string").write.format("noop").mode("overwrite").save()
    _sweep(store, path)
    return manifest


def _sweep(store, path: str) -> None:
    """Remove what attempts that didn't win left under temporary names."""
    from pyarrow import fs

    for found in store.get_file_info(fs.FileSelector(path)):
        if found.base_name.startswith("tmp-"):
            store.delete_file(found.path)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC fields, HTTP head, payload) of each gzip member of an archive."""
    z, raw, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            break
        raw.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            whole = b"".join(raw)
            head, _, tail = whole.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0]!r}")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = tail[: int(fields["Content-Length"])]
            if tail[len(block) :] != b"\r\n\r\n" or f"sha1:{b32_sha1(block)}" != fields["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            http, _, payload = block.partition(b"\r\n\r\n")
            yield fields, http, payload
            z, raw = zlib.decompressobj(31), []
    if raw:
        raise ValueError("the archive ends within a record")


_READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _read(target: str):
    def page(name: str) -> str | None:
        return name.split(":")[2] or None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(target)
        for b in batches:
            for name in b["name"]:
                rows = []
                with store.open_input_stream(name, compression=None) as stream:
                    for fields, http, payload in records_of(stream):
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != n or b32_sha1(payload) != digest):
                            raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                        refers = page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), n, digest, kind, refers))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    return run


def read_archives(manifest: DataFrame, target: str) -> DataFrame:
    """One row per record of the manifest's archives; every digest is checked."""
    files = manifest.select("name").repartition(partitions(manifest.sparkSession))
    return with_id(with_id(files.mapInPandas(_read(target), _READ), "page_id"), "refers_to")


def op9_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    from .common import table

    target = scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), target)
    return read_archives(manifest, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
