import numpy as np
import pytest

from cadenza.sources import rawvideo


def test_frames_come_back(spark, tmp_path):
    from cadenza.plans.catalogue import read  # noqa: F401  the package is importable by workers

    video = np.arange(7 * 4 * 5 * 3, dtype=np.uint64).astype(np.uint8).reshape(7, 4, 5, 3)
    (tmp_path / "a.raw").write_bytes(video.tobytes())
    spark.sparkContext.environment["PYTHONPATH"] = rawvideo.__file__.rsplit("/cadenza/", 1)[0]
    reader = rawvideo._Reader({"path": str(tmp_path / "a.raw"), "height": "4", "width": "5", "framesPerPartition": "3"})
    parts = reader.partitions()
    assert [(p.first, p.stop) for p in parts] == [(0, 3), (3, 6), (6, 7)]
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[1] for r in rows] == list(range(7)) and b"".join(r[5] for r in rows) == video.tobytes()
    with pytest.raises(ValueError, match="whole number"):
        rawvideo._Reader({"path": str(tmp_path / "a.raw"), "height": "4", "width": "6"}).partitions()


def test_as_a_data_source(spark, tmp_path):
    (tmp_path / "b.raw").write_bytes(bytes(range(24)) * 5)
    rawvideo.register(spark)
    df = spark.read.format("rawframes").option("height", 2).option("width", 4).option("framesPerPartition", 2).load(str(tmp_path / "b.raw"))
    rows = df.orderBy("frame").collect()
    assert len(rows) == 5 and all(bytes(r["data"]) == bytes(range(24)) for r in rows)
