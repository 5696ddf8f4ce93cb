"""Point states in streams, landed frames, progress."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import point_ages as P
from cadenza.sources import landed


def sightings(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), k, rng.choice([None, 0, 1, 2, 3, 4]), rng.choice([None, True, True, True, False])) for k in range(n)]


SCHEMA = "g string, k long, point double, kept boolean"


def plain(rows):
    ages, out = {}, []
    for g, k, p, kept in rows:
        mine = ages.setdefault(g, {})
        if p is not None and kept is not None:
            if kept:
                mine[p] = mine.get(p, 0) + 1
            else:
                mine.pop(p, None)
        out.append((g, k, mine.get(p, 0) if p is not None else 0, len(mine)))
    return sorted(out)


def test_stream_equals_batch_over_uneven_batches_and_a_restart(spark, tmp_path):
    rows = [(g, k, None if p is None else float(p), kept) for g, k, p, kept in sightings(400, 5)]
    batch = P.point_ages(spark.createDataFrame(rows, SCHEMA).repartition(3), "g", ["k"], "point", "kept")
    assert sorted((r.g, r.k, r.age, r.points) for r in batch.collect()) == plain(rows)
    cuts = [0, 3, 150, 151, 390, 400]

    def add(k):
        spark.createDataFrame(rows[cuts[k] : cuts[k + 1]], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = P.stream_point_ages(stream, "g", ["k"], "point", "kept")
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    for k in range(5):
        add(k)
        if k in (0, 2, 4):
            run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.g, r.k, r.age, r.points) for r in got) == plain(rows)


def frames(spark, n):
    base = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("video"), F.expr("cast(id div 2 as int)").alias("frame"))
    return base.select("*", *[F.lit(v).alias(c) for c, v in (("height", 1), ("width", 2), ("channels", 1))], F.unhex(F.lpad(F.hex(F.col("frame") % 65536), 4, "0")).alias("data"))


def save(df, path):
    df.sortWithinPartitions("video", "frame").write.format("landedframes").mode("append").save(path)


def test_frames_land_at_once_and_come_back(spark, tmp_path):
    landed.register(spark)
    path = f"{tmp_path}/frames"
    save(frames(spark, 41).repartition(3), path)
    save(frames(spark, 41).filter("frame < 0"), path)
    read = spark.read.format("landedframes").option("framesPerPartition", 4).load(path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, frames(spark, 41).collect()))
    save(frames(spark, 4), path)
    assert spark.read.format("landedframes").load(path).count() == 45 and len(list((tmp_path / "frames").glob("*.json"))) == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    landed.register(spark)
    path = f"{tmp_path}/frames"
    save(frames(spark, 4), path)
    before = sorted(p.name for p in (tmp_path / "frames").iterdir() if not p.name.startswith("."))
    short = frames(spark, 40).withColumn("data", F.when(F.col("frame") == 13, F.unhex(F.lit("00"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="bytes aren't"):
        save(short.repartition(4), path)
    assert sorted(p.name for p in (tmp_path / "frames").iterdir() if not p.name.startswith(".")) == before
    assert spark.read.format("landedframes").load(path).count() == 4
    writer = landed._Writer({"path": path}, ["video", "frame", "height", "width", "channels", "data"])
    done = writer.write(iter([("v", 0, 1, 1, 1, b"x"), ("v", 1, 1, 1, 1, b"y"), ("w", 5, 1, 1, 1, b"z")]))
    assert [r[1:4] for r in done.runs] == [("v", 0, 2), ("w", 5, 1)]
    writer.abort([done, None])
    assert sorted(p.name for p in (tmp_path / "frames").iterdir() if not p.name.startswith(".")) == before


def test_streams_see_each_landing_once(spark, tmp_path):
    landed.register(spark)
    path = f"{tmp_path}/frames"

    def run():
        stream = spark.readStream.format("landedframes").load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    for low, high in ((0, 10), (10, 11), (11, 30)):
        save(frames(spark, 30).filter(F.col("frame").between(low // 2, high // 2 - 1)), path)
        run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == spark.read.format("landedframes").load(path).count()


def test_counts_come_with_batches(spark, tmp_path):
    from cadenza.plans.progress import Progress, marked, observed

    df = spark.createDataFrame([(k, None if k % 10 == 0 else k % 3 > 0) for k in range(60)], "k long, ok boolean")
    rows, counts = observed(df, "batch counts", F.col("ok"))
    rows.write.parquet(f"{tmp_path}/rows")
    want = {"rows": 60, "accepted": 36, "rejected": 24}
    assert counts.get == want
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
        out = marked(stream, "stream counts", F.col("ok")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state")
        out.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        for _ in range(100):
            if listener.totals.get("stream counts") == want:
                break
            spark.sparkContext._jvm.Thread.sleep(100)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["stream counts"] == want and listener.batches["stream counts"] > 1


def test_header_from_the_first_rows_keys(spark, tmp_path):
    from cadenza.sources import tables as IO

    rows = [(2, {"a": "3", "c": "left out"}), (1, {"b": "1", "a": "2"}), (3, None)]
    df = spark.createDataFrame(rows, "k long, fields map<string,string>")
    assert IO.write_by_keys(df, f"{tmp_path}/rows", "fields", "k") == ["a", "b"]
    got = spark.read.option("header", True).csv(f"{tmp_path}/rows")
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect()), key=str) == [("2", "1"), ("3", None), (None, None)]
    assert IO.write_by_keys(df.filter("k > 5"), f"{tmp_path}/none", "fields", "k") is None and not (tmp_path / "none").exists()


def test_names_of_runs(spark):
    from cadenza.sources import tables as IO

    df = spark.createDataFrame([(k, "run" if k % 2 else "x") for k in range(6)] + [(9, None)], "k long, base string")
    got = {r.k: r.name for r in IO.run_names(df, [], "base", "k").collect()}
    assert got == {0: "x", 1: "run", 2: "x_01", 3: "run_01", 4: "x_02", 5: "run_02", 9: None}


def test_short_pieces_share_tasks():
    single = [landed.Piece("f", 2 * k, "v", 3 * k, 1, 1, 2, 1) for k in range(10_000)]
    dealt = landed.shares(single, 7)
    assert len(dealt) <= landed.PARTITIONS + 1 and [p for s in dealt for p in s.pieces] == single
    assert [len(s.pieces) for s in landed.shares(single[:3], 1)] == [1, 1, 1]
    large = [landed.Piece("f", 0, "v", 0, 1, 1, landed.PARTITION_BYTES, 1)] * 3
    assert [len(s.pieces) for s in landed.shares(large, 1)] == [1, 1, 1] and landed.shares([], 7) == []


def test_a_batch_meets_a_points_state_once():
    import pandas as pd

    calls = []

    class Ages(dict):
        def containsKey(self, k):
            calls.append(k)
            return k in self

        def getValue(self, k):
            calls.append(k)
            return self[k]

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

        def removeKey(self, k):
            calls.append(k)
            del self[k]

    class Count:
        n = None

        def exists(self):
            return self.n is not None

        def get(self):
            return self.n

        def update(self, v):
            self.n = v

    tracked = P._Tracked(["k"], ["k"])
    tracked.ages, tracked.count = Ages(), Count()
    words = {None: None, True: "true", False: "false"}
    rows = [(k, None if p is None else str(p), words[kept]) for _, k, p, kept in sightings(300, 9)]
    got = [r for part in (rows[:200], rows[200:]) for out in tracked.handleInputRows(None, iter([pd.DataFrame([(k, "s", p, kept) for k, p, kept in part])]), None) for r in out.itertuples(index=False, name=None)]
    want = plain([("s", k, p, None if kept is None else kept == "true") for k, p, kept in rows])
    assert got == [(k, age, points) for _, k, age, points in want]
    assert len(calls) <= 2 * 5 * 3
