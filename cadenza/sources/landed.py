"""Frames landed in a folder: `format("landedframes")`, written and read, in
batches and as a stream.

A task writes its rows to one file, runs of consecutive frames of a video one
after the other; commit lists all tasks' runs in the folder's next manifest
(000000.json, 000001.json, ...), which makes them visible at once. Abort removes
what tasks wrote, and files that no manifest names are never read, so a task that
fails or runs twice leaves no frame. A stream's offset is the number of manifests
seen. Frames are read in pieces of runs, framesPerPartition (256) frames each at
most; a partition takes pieces together while they have no more frames than that, or
where there would be more than PARTITIONS, so single frames and short pieces don't
cost a task each. Options: path, which pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .rawvideo import _open
from .schemas import FRAMES

RUN = 256
#: Partitions that short pieces are dealt to, until these have PARTITION_BYTES.
PARTITIONS = 256
PARTITION_BYTES = 64 << 20


@dataclass
class Landed(WriterCommitMessage):
    """One task's file and its runs: (offset, video, first frame, frames, height,
    width, channels)."""

    file: str | None
    runs: list[tuple]


@dataclass
class Piece:
    file: str
    offset: int
    video: str
    first: int
    count: int
    height: int
    width: int
    channels: int

    @property
    def size(self) -> int:
        return self.count * self.height * self.width * self.channels


@dataclass
class Share(InputPartition):
    """The pieces that one task reads."""

    pieces: list[Piece]


def shares(pieces: list[Piece], most: int) -> list[Share]:
    """Pieces in order, dealt out: a share has at most `most` frames, or at most
    its part of all bytes, or one piece."""
    part = min(PARTITION_BYTES, -(-sum(p.size for p in pieces) // PARTITIONS))
    out, frames, held = [], 0, 0
    for p in pieces:
        frames, held = frames + p.count, held + p.size
        if not out or (frames > most and held > part):
            out.append(Share([]))
            frames, held = p.count, p.size
        out[-1].pieces.append(p)
    return out


class LandedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landedframes"

    def schema(self):
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("frames are only ever added to a folder")
        return _Writer(self.options, [f.name for f in schema.fields])


class _Folder:
    def __init__(self, options):
        self.uri = options["path"].rstrip("/")
        self.run = int(options.get("framesPerPartition", RUN))

    def manifests(self) -> list[str]:
        from pyarrow import fs

        store, path = _open(self.uri)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def pieces(self, first: int, stop: int) -> list[Piece]:
        store, _ = _open(self.uri)
        out = []
        for path in self.manifests()[first:stop]:
            with store.open_input_stream(path) as f:
                listed = json.loads(f.read())
            for name, offset, video, frame, count, *shape in listed:
                size = shape[0] * shape[1] * shape[2]
                out += [Piece(name, offset + k * size, video, frame + k, min(self.run, count - k), *shape) for k in range(0, count, self.run)]
        return out

    def frames(self, share: Share) -> Iterator[tuple]:
        for name, pieces in groupby(share.pieces, lambda p: p.file):
            store, path = _open(f"{self.uri}/{name}")
            with store.open_input_file(path) as f:
                for p in pieces:
                    size = p.height * p.width * p.channels
                    f.seek(p.offset)
                    for k in range(p.count):
                        yield p.video, p.first + k, p.height, p.width, p.channels, f.read(size)


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[Share]:
        return shares(self.pieces(0, len(self.manifests())), self.run)

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.frames(partition)


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"manifests": 0}

    def latestOffset(self) -> dict:
        return {"manifests": len(self.manifests())}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return shares(self.pieces(start["manifests"], end["manifests"]), self.run)

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.frames(partition)


class _Writer(_Folder, DataSourceWriter):
    def __init__(self, options, names: list[str]):
        super().__init__(options)
        self.places = [names.index(c) for c in ("video", "frame", "height", "width", "channels", "data")]

    def write(self, iterator: Iterator) -> Landed:
        from pyarrow import fs

        name = f"{uuid.uuid4().hex}.frames"
        store, path = _open(f"{self.uri}/{name}")
        runs, at, last = [], 0, None
        try:
            out = None
            for row in iterator:
                video, frame, height, width, channels, data = (row[k] for k in self.places)
                if len(data) != height * width * channels:
                    raise ValueError(f"frame {frame} of {video}: {len(data)} bytes aren't {height} x {width} x {channels}")
                if out is None:
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(path)
                this = (video, height, width, channels)
                if last == (*this, frame - 1):
                    runs[-1][3] += 1
                else:
                    runs.append([at, video, frame, 1, height, width, channels])
                out.write(data)
                at, last = at + len(data), (*this, frame)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)
            raise
        return Landed(name if runs else None, [tuple(r) for r in runs])

    def commit(self, messages: list[Landed | None]) -> None:
        listed = [(m.file, *r) for m in messages if m for r in m.runs]
        if not listed:
            return
        store, path = _open(self.uri)
        aside = f"{path}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps(listed).encode())
        store.move(aside, f"{path}/{len(self.manifests()):06d}.json")

    def abort(self, messages: list[Landed | None]) -> None:
        for m in messages:
            if m and m.file:
                store, path = _open(f"{self.uri}/{m.file}")
                store.delete_file(path)


def register(spark) -> None:
    spark.dataSource.register(LandedFrames)
