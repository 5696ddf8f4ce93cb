"""Uncompressed video as a Spark data source: `spark.read.format("rawframes")`.

Files hold frames of height x width x channels bytes one after the other. A
partition is a run of frames, so one long video is read by many tasks. Options:
path (a file, or several with commas), width, height, channels (3), frames per
partition (256). Paths may be URIs that pyarrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .schemas import FRAMES


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, inner


@dataclass
class FrameRun(InputPartition):
    path: str
    first: int
    stop: int


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self):
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.height, self.width = int(options["height"]), int(options["width"])
        self.channels = int(options.get("channels", 3))
        self.run = int(options.get("framesPerPartition", 256))
        self.size = self.height * self.width * self.channels
        if not self.paths or self.size <= 0 or self.run <= 0:
            raise ValueError("path, height and width are needed")

    def partitions(self) -> list[FrameRun]:
        out = []
        for p in self.paths:
            store, inner = _open(p)
            n = store.get_file_info(inner).size
            if n is None or n % self.size:
                raise ValueError(f"{p} isn't a whole number of frames")
            n //= self.size
            out += [FrameRun(p, k, min(k + self.run, n)) for k in range(0, n, self.run)]
        return out

    def read(self, partition: FrameRun) -> Iterator[tuple]:
        store, inner = _open(partition.path)
        with store.open_input_file(inner) as f:
            f.seek(partition.first * self.size)
            for k in range(partition.first, partition.stop):
                yield partition.path, k, self.height, self.width, self.channels, f.read(self.size)


def register(spark) -> None:
    spark.dataSource.register(RawFrames)
