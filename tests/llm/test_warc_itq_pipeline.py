"""Archives, embeddings, and the pipeline end to end."""

import base64
import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import itq, packing, pii, quality, registry, suffix_dedup, warc
from cadenza.llm.common import scratch, table

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def pages(spark):
    rows = [(1, "u", "a"), (2, "u\r\nx", "a"), (3, None, None), (4, "v", ""), (None, "w", "a"), (2, "u", "a"), (9, "z", "é" * 5000), (12, "q", "only")]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip(spark):
    target = scratch(spark, "warc")
    manifest = warc.write_archives(pages(spark), target, shard_bytes=4000, roll_bytes=300)
    rows = sorted(warc.read_archives(manifest, target).collect(), key=lambda r: (r["page_id"] or -1, r["url"] or ""))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows]
    assert got == [(None, "revisit", 1, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (2, "revisit", 1, 1), (3, "response", None, 0), (4, "revisit", 3, 0), (9, "response", None, 10000), (12, "response", None, 4)]
    assert rows[6]["payload_digest"] == base64.b32encode(hashlib.sha1(("é" * 5000).encode()).digest()).decode()


def test_least_size_and_empty(spark):
    target = scratch(spark, "warc")
    rows = warc.read_archives(warc.write_archives(pages(spark), target, least=2), target).collect()
    assert {r["record_type"] for r in rows} == {"response"} and len(rows) == 8
    target = scratch(spark, "warc")
    assert warc.read_archives(warc.write_archives(pages(spark).limit(0), target), target).collect() == []


def test_files_depend_on_the_rows_alone(spark):
    sums = []
    for n in (1, 5):
        m = warc.write_archives(pages(spark).repartition(n), scratch(spark, "warc"), shard_bytes=4000, roll_bytes=300).collect()
        sums.append(sorted((r["name"].rsplit("/", 1)[1], r["sha256"], r["records"]) for r in m))
    assert sums[0] == sums[1] and len(sums[0]) > 2


def _shards(spark, rows, shard_bytes, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    target = scratch(spark, "warc")
    manifest = warc.write_archives(df, target, shard_bytes=shard_bytes)
    back = warc.read_archives(manifest, target).collect()
    return {r["shard"]: r["records"] for r in manifest.groupBy("shard").agg(F.sum("records").alias("records")).collect()}, back


def test_shards_of_outlying_hot_and_many_ids(spark):
    far = [(k, "u", f"{k:04d}" * 25) for k in range(300)] + [(2**60, "u", "far" * 30), (-(2**62), "u", "near" * 20), (2**63 - 1, None, "end"), (-(2**63), None, "low")]
    sizes, back = _shards(spark, far, 1000)
    assert len(back) == 304 and max(sizes.values()) <= 21 and len(sizes) > 25
    assert sorted(r["page_id"] for r in back) == sorted(r[0] for r in far)
    hot = [(7, "u", f"{k:04d}" * 25) for k in range(300)] + [(k, "u", "x" * 100) for k in range(5)]
    sizes, back = _shards(spark, hot, 1000)
    assert len(back) == 305 and max(sizes.values()) <= 21 and len(sizes) > 25
    same = [(7, "u", "y" * 100)] * 300 + [(3, "u", "y" * 100), (None, "u", "y" * 100)]
    sizes, back = _shards(spark, same, 1000)
    assert len(back) == 302 and max(sizes.values()) <= 25
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in back) == {(7, "revisit", 3): 300, (3, "response", None): 1, (None, "revisit", 3): 1}
    many = [(k, "u", "z") for k in range(300)]
    sizes, back = _shards(spark, many, 1)
    assert len(back) == 300 and set(sizes.values()) == {1}


def test_shards_depend_on_the_rows_alone(spark):
    rng = random.Random(3)
    rows = [(rng.choice([rng.randint(-50, 50), 2**50 + rng.randint(0, 9), 4]), rng.choice("ab"), "k" * rng.randint(0, 300)) for _ in range(400)]
    assert _shards(spark, rows, 900, 1)[0] == _shards(spark, rows[::-1], 900, 7)[0]


def test_left_over_files_go(spark):
    target = scratch(spark, "warc")
    store, path = warc._store(target)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/tmp-dead-000000-00000") as f:
        f.write(b"half")
    warc.write_archives(pages(spark), target)
    assert not [f for f in store.get_file_info(FileSelector(path)) if f.base_name.startswith("tmp-")]


def test_damage_is_found(tmp_path):
    good = warc.member(warc.record(1, "0", "u", b"payload", None, True))
    (tmp_path / "a").write_bytes(good)
    with open(tmp_path / "a", "rb") as f:
        assert [p for _, _, p in warc.records_of(f)] == [b"payload"]
    (tmp_path / "b").write_bytes(warc.member(warc.record(1, "0", "u", b"payload", None, True).replace(b"payload", b"paYload")))
    with open(tmp_path / "b", "rb") as f, pytest.raises(ValueError, match="damaged"):
        list(warc.records_of(f))
    (tmp_path / "c").write_bytes(good[:-9])
    with open(tmp_path / "c", "rb") as f, pytest.raises(ValueError, match="ends within"):
        list(warc.records_of(f))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def clusters(seed=1, n=400, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = np.vstack([centres[rng.integers(0, 20, n // 2)] + 0.35 * rng.normal(size=(n // 2, dim)), rng.normal(size=(n // 2, dim))])
    x[5] = x[6] * 2
    return x


def test_recall_and_precision(spark):
    x = clusters()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = sorted(itq.near_duplicates(df).collect(), key=lambda r: r["vec_id"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    got = np.array([r["n_links"] for r in out])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum() > 0
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out)


def test_vector_edges(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [0.99, 0.1]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1e300, 1e300]), (10, [inf, 1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cls int")
    out = {(r["vec_id"], r["n_links"], r["component_id"]) for r in itq.near_duplicates(df).collect()}
    assert out == {(None, 4, 1), (1, 4, 1), (2, 4, 1), (7, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (8, 0, 8), (9, 0, 9), (10, 0, 10)}
    assert itq.near_duplicates(df.limit(0)).collect() == []


@needs_data
def test_pipeline_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, SF)
    crf = quality.train(docs, table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in quality.judge(docs, crf).filter("kept").select("doc_id").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.select("doc_id").collect()} == kept

    from .test_minhash import brute_set, similarity
    from .test_simhash_components import groups

    rows = good.orderBy("doc_id").collect()
    sets = [brute_set(r["text"]) for r in rows]
    roots = groups(len(rows), lambda i, j: similarity(sets[i], sets[j]) >= 0.8)
    single = stage["simhash_near_dedup"](spark, good, SF)
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.select("doc_id").collect()) == [r["doc_id"] for i, r in enumerate(rows) if roots[i] == i]

    from .test_suffix_dedup import brute

    rows = single.orderBy("doc_id").collect()
    cut = {r["doc_id"]: r for r in stage["suffix_array_dedup"](spark, single, SF).collect()}
    for r, (_, _, _, digest) in zip(rows, brute([r["text"] for r in rows]), strict=True):
        text = cut[r["doc_id"]]["text"]
        assert cut[r["doc_id"]]["n_chars"] == len(text)
        assert hashlib.sha256(text.encode()).hexdigest() == digest or not text.isascii()

    final = {r["doc_id"]: r["text"] for r in stage["pii_surrogates"](spark, spark.createDataFrame(list(cut.values()), docs.schema), SF).collect()}
    old = {(k, c) for r in cut.values() for _, _, k, c in pii.detect(r["text"])}
    assert not old & {(k, c) for t in final.values() for _, _, k, c in pii.detect(t)}

    df = spark.createDataFrame(sorted(final.items()), "doc_id long, text string")
    e = packing.encoder(packing.default_tokenizer())
    n = {r["doc_id"]: r["doc_tokens"] for r in stage["packing"](spark, df, SF).collect()}
    assert n == {i: len(e.model.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}


def test_rows_with_clashing_names(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(80)) for _ in range(4)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, row int, own int, kept int")
    for _, f in corpus_pipeline.STAGES[1:4]:
        out = f(spark, df, SF)
        assert out.columns == df.columns and out.count() == 4
    assert suffix_dedup.LENGTH == 200
