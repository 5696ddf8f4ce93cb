"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the
vector of the segments' bit counts. The Manhattan distance of two embeddings is
a lower bound of the Hamming distance, so fingerprints within D bits have
embeddings within D. The embedding's axes are gathered into BLOCKS groups; by
the pigeonhole principle two such embeddings are equal on BLOCKS - D groups at
least, so they share a cell in one of the C(BLOCKS, BLOCKS - D) grids. Within a
cell the Manhattan bound is tested first, then the Hamming distance exactly.

The number of BLOCKS follows the number of fingerprints: more blocks make narrower
cells and more grids, so that chance neighbours stay few however many there are.

A cell of any size is handled exactly and never emits all its pairs: what
leaves a task is a spanning forest of the links it found. A cell with more than
CELL rows is passed on in pieces; every pair of pieces is then a task of its own.

Copies with the same fingerprint are one node. Null or empty texts (no word)
have fingerprint zero and link like any other; rows with a null id take part in
no link of their own but get their fingerprint's component.

similar_texts() takes a least Jaccard similarity of the shingles' sets in place of a
distance. Pairs within the distance are candidates there, found as above; as
fingerprints of less alike texts differ in too many bits for selective grids (10 of
64 on average at 0.8), the rest come from minima of the sets (minhash.py). All are
decided by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clumps, minhash
from .common import discard, id_text, materialize, partitions, with_id
from .components import components
from .forest import Forest

SEGMENTS = 32
CELL = 20_000
PIECE = 5_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, n)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(line[s:e], seed) for s, e in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)),
        np.uint64,
        n - k + 1,
    )
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        count = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        count = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width, seed) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return run


def embed(fp: np.ndarray) -> np.ndarray:
    """uint64: the bit count of each two-bit segment, in that segment's place.
    Two embeddings' Manhattan distance is that of the 2-bit fields."""
    m = np.uint64(0x5555555555555555)
    x = fp.view(np.uint64)
    return (x & m) + ((x >> np.uint64(1)) & m)


def blocks_of(blocks: int) -> list[np.uint64]:
    """Masks that deal the 32 segments out to `blocks` groups of nearby size."""
    masks = []
    for segs in np.array_split(np.arange(SEGMENTS), blocks):
        v = 0
        for s in segs.tolist():
            v |= 3 << (2 * s)
        masks.append(np.uint64(v))
    return masks


def blocks_for(nodes: int, distance: int) -> int:
    """The least number of blocks whose cells, of some 1.5 bits a segment, hold
    fewer than eight fingerprints by chance."""
    blocks = distance + 3
    while blocks < SEGMENTS and 1.5 * SEGMENTS * (blocks - distance) / blocks < np.log2(max(nodes, 1) / 8):
        blocks += 1
    return blocks


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _cells(distance: int, blocks: int):
    masks = blocks_of(blocks)
    grids = [
        np.bitwise_or.reduce(np.array(c, np.uint64)) for c in combinations(masks, blocks - distance)
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, node = b["fp"].to_numpy(np.int64), b["node"].to_numpy(np.int64)
            e = embed(fp)
            for g, mask in enumerate(grids):
                yield pd.DataFrame({"cell": _mix(e & mask, g + 1).view(np.int64), "fp": fp, "node": node})

    return run


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: fields hold 0, 1 or 2, so |a-b| per
    field is 2 where one has its high bit and the other is 0, else a xor of
    the parities."""
    m = np.uint64(0x5555555555555555)
    x = a ^ b
    low = x & m
    two = (x >> np.uint64(1)) & m & ~low
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)


def link_runs(key: np.ndarray, fp: np.ndarray, distance: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the rows of equal key (rows sorted by key) that lie
    within `distance` bits. With `side`, only pairs of unlike side count."""
    n = len(key)
    forest = Forest(n)
    e, x = embed(fp), fp.view(np.uint64)
    at = np.arange(n)
    shift = 1
    while len(at):
        at = at[at + shift < n]
        at = at[key[at] == key[at + shift]]
        to = at + shift
        near = _l1(e[at], e[to]) <= distance
        if side is not None:
            near &= side[at] != side[to]
        i, j = at[near], to[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= distance
        if near.any():
            forest.join(i[near], j[near])
        shift += 1
    return forest.links


_LINKED = "a long, b long, cell long, piece long, fp long"


def _rows(a, b, cell, piece, fp) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b, "cell": cell, "piece": piece, "fp": fp}).astype("int64")


def _link(distance: int, cell_rows: int, piece_rows: int):
    """Rows come sorted by cell. Links leave with piece -1; the rows of a cell
    beyond cell_rows leave unlinked with the number of their piece."""

    def flush(cell, fp, node):
        links = link_runs(cell, fp, distance)
        if not links:
            return None
        i, j = np.array(links).T
        return _rows(node[i], node[j], 0, -1, 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * 3
        hot, passed = None, 0
        for b in batches:
            cell, fp, node = (np.concatenate((h, b[c].to_numpy(np.int64))) for h, c in zip(held, ("cell", "fp", "node"), strict=True))
            while len(cell):
                first = int(np.searchsorted(cell, cell[0], "right"))
                if cell[0] == hot or first > cell_rows:
                    if cell[0] != hot:
                        hot, passed = cell[0], 0
                    yield _rows(node[:first], node[:first], hot, (passed + np.arange(first)) // piece_rows, fp[:first])
                    passed += first
                    cell, fp, node = cell[first:], fp[first:], node[first:]
                    continue
                last = int(np.searchsorted(cell, cell[-1], "left"))
                sizes = np.flatnonzero(np.diff(cell[:last])) + 1
                bounds = np.concatenate(([0], sizes, [last]))
                big = np.flatnonzero(np.diff(bounds) > cell_rows)
                stop = int(bounds[big[0]]) if len(big) else last
                if stop:
                    if (out := flush(cell[:stop], fp[:stop], node[:stop])) is not None:
                        yield out
                    cell, fp, node = cell[stop:], fp[stop:], node[stop:]
                if not len(big):
                    break
            held = [cell, fp, node]
        if len(held[0]) and (out := flush(*held)) is not None:
            yield out

    return run


def _link_pieces(distance: int):
    """One pair of pieces of one cell: a group of at most two pieces' rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, node = pdf["fp"].to_numpy(np.int64), pdf["a"].to_numpy(np.int64)
        side = pdf["piece"].to_numpy(np.int64)
        own = int(pdf["i"].iloc[0]) == int(pdf["j"].iloc[0])
        links = link_runs(np.zeros(len(fp), np.int64), fp, distance, None if own else side)
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": node[i], "b": node[j]})

    return run


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, cell_rows: int = CELL, piece_rows: int = PIECE) -> DataFrame:
    """(a, b) edges between nodes(fp, node) that connect exactly the nodes
    joined by chains of fingerprints at `distance` bits or fewer."""
    spark = nodes.sparkSession
    blocks = blocks or blocks_for(nodes.count(), distance)
    cells = nodes.mapInPandas(_cells(distance, blocks), "cell long, fp long, node long")
    spread = cells.repartition(partitions(spark), "cell").sortWithinPartitions("cell")
    out = materialize(spread.mapInPandas(_link(distance, cell_rows, piece_rows), _LINKED), "simhash-links")
    edges = out.filter("piece < 0").select("a", "b")
    hot = out.filter("piece >= 0")
    if hot.isEmpty():
        return edges
    count = materialize(hot.groupBy("cell").agg((F.max("piece") + 1).alias("n")), "simhash-hot")
    pairs = hot.join(count, "cell").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = pairs.withColumn("i", F.least("piece", "other")).withColumn("j", F.greatest("piece", "other"))
    return edges.unionByName(pairs.groupBy("cell", "i", "j").applyInPandas(_link_pieces(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint as a signed long) and
    component_id, the least id reachable over links of `distance` bits or fewer."""
    rows = docs.select(id_text(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fps = materialize(with_id(rows.mapInPandas(_fingerprints(width, seed), "doc_id string, fp long"), "doc_id"), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    real = nodes.filter("node is not null")
    roots = components(links(real, distance, blocks))
    named = materialize(
        nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "simhash-roots"
    )
    discard(nodes)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _joined_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) as components() gives them, after further edges (a, b): only
    the roots that these join are looked at again."""
    ends = edges
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    met = ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    new = materialize(components(met), "simhash-joined")
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
    return materialize(moved.select("node", F.coalesce("next", "root").alias("root")).unionByName(new), "simhash-roots")


def similar_texts(rows: DataFrame, width: int = minhash.WIDTH, least: float = minhash.LEAST, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(row, component) for rows(row, text): `row` names a row, equal names have
    equal texts; a component holds the rows joined by chains of Jaccard
    similarity `least` or more over shingles of `width` words.

    Classes of equal sets are tested in three steps: against the least class of
    their fullest cell and their fingerprint's neighbours; then, where a cell
    still holds several components, one class of each against one of the most
    frequent; then all pairs of unlike components that share a cell, tested in
    arrays by parts of groups (clumps.py). So a group of near-equal texts makes
    rows by its size, not its pairs, and none of the links that decide a component
    is left out."""
    sketch = minhash.SKETCH
    signed = materialize(rows.mapInPandas(minhash.signatures(width, majority), minhash.SIGNED), "simhash-rows")
    classes = materialize(signed.groupBy("cls").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), *[F.first(c).alias(c) for c in (*sketch, "cells")]), "simhash-classes")
    texts = rows.join(classes.select("row", "cls"), "row").select("cls", "text").dropDuplicates(["cls"])
    sketches = classes.select("cls", *sketch)

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those whose sketches are close."""
        for side in ("a", "b"):
            named = sketches.select(F.col("cls").alias(side), F.struct(*sketch).alias(f"s{side}"))
            pairs = pairs.join(named, side)
        return materialize(pairs.filter(minhash.close("sa", "sb")).select("a", "b"), "simhash-pairs")

    posted = classes.select(F.explode("cells").alias("cell"), "cls")
    cells = posted.groupBy("cell").agg(F.count("*").alias("n"), F.min("cls").alias("lead")).filter("n > 1")
    shared = materialize(posted.join(materialize(cells, "simhash-cells"), "cell"), "simhash-shared")

    prints = materialize(classes.groupBy("fp").agg(F.min("cls").alias("node")), "simhash-nodes")
    within = links(prints, distance, blocks).unionByName(classes.join(prints, "fp").select(F.col("node").alias("a"), F.col("cls").alias("b")))
    fullest = shared.filter("cls <> lead").groupBy("cls").agg(F.max_by("lead", F.struct("n", "cell")).alias("lead"))
    stars = within.unionByName(fullest.select(F.col("lead").alias("a"), F.col("cls").alias("b"))).filter("a <> b")
    stars = near(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = minhash.verified(stars, texts, width, least)
    roots = materialize(components(first), "simhash-roots")

    def rooted() -> tuple[DataFrame, DataFrame, DataFrame]:
        """shared with each class's component; a class of each component that
        isn't its cell's most frequent; cells that hold several components."""
        named = shared.select("cell", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        heads = named.groupBy("cell", "root").agg(F.count("*").alias("n"), F.min("cls").alias("head"))
        major = heads.groupBy("cell").agg(F.max_by(F.struct("root", "head"), F.struct("n", "root")).alias("major"), F.count("*").alias("k")).filter("k > 1")
        return named, heads.join(major, "cell").filter(F.col("root") != F.col("major.root")), major

    _, heads, _ = rooted()
    pairs = heads.select(F.least("head", "major.head").alias("a"), F.greatest("head", "major.head").alias("b")).distinct()
    heads = near(pairs.join(stars, ["a", "b"], "left_anti"))
    roots = _joined_roots(roots, minhash.verified(heads, texts, width, least))

    named, _, major = rooted()
    mixed = materialize(named.join(major.select("cell"), "cell").join(sketches, "cls"), "simhash-mixed")
    whole = _joined_roots(roots, clumps.links(mixed, texts, width, least))
    for df in (shared, prints, stars, heads, mixed):
        discard(df)
    return signed.select("row", "cls").join(whole.withColumnRenamed("node", "cls"), "cls", "left").select("row", F.coalesce("root", "cls").alias("component"))


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
