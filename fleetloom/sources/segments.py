"""Following a feed of text segments that still grow, from a stored (segment, byte position)."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fleetloom.session import ship_package

SCHEMA = "segment string, position long, value string"
BYTES_PER_TASK = 64 << 20
BATCH_BYTES = 4 << 20
MARK_BYTES = 256
TAIL_BYTES = 1 << 16


@dataclass
class Piece(InputPartition):
    """Lines of a segment that begin in [begin, end); ``stop`` is where the segment's last line of this batch ends."""

    segment: str
    begin: int
    end: int
    stop: int
    whole_line: bool


def segment_order(name: str) -> tuple:
    """Segments in order of name, with runs of digits compared as numbers: log.999999 comes before log.1000000."""
    parts = re.split(r"(\d+)", name)
    return (*[int(x) if i % 2 else x for i, x in enumerate(parts)], name)


class SegmentFolder:
    """The segments below a folder and the feed's rules; positions are dicts of segment, position and mark."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.start_segment = options.get("start_segment", "")
        self.start_position = int(options.get("start_position", 0))
        self.bytes_per_task = int(options.get("bytes_per_task", BYTES_PER_TASK))
        self.missing = options.get("missing", "error")
        if self.missing not in ("error", "skip"):
            raise ValueError("missing must be error or skip")

    def _open(self):
        where, root = fs.FileSystem.from_uri(self.path)
        return where, root.rstrip("/")

    def sizes(self) -> dict[str, int]:
        """Size of every segment, in order; files and folders whose names begin with _ or . are none."""
        where, root = self._open()
        found = {}
        for x in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = x.path[len(root) + 1 :]
            if x.type == fs.FileType.File and not any(p[0] in "_." for p in name.split("/")):
                found[name] = x.size
        return dict(sorted(found.items(), key=lambda x: segment_order(x[0])))

    def _bytes(self, segment: str, begin: int, end: int) -> bytes:
        where, root = self._open()
        with where.open_input_file(f"{root}/{segment}") as f:
            return f.read_at(end - begin, begin)

    def mark(self, segment: str, position: int) -> str:
        """Digest of the bytes just before a position: another file under the same name shows by it."""
        if not position:
            return ""
        return hashlib.sha256(self._bytes(segment, max(0, position - MARK_BYTES), position)).hexdigest()[:32]

    def last_line_end(self, segment: str, size: int) -> int:
        """Position behind the last line feed."""
        end = size
        while end:
            begin = max(0, end - TAIL_BYTES)
            at = self._bytes(segment, begin, end).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
        return 0

    def first(self) -> dict:
        if not self.start_segment or not self.start_position:
            return {"segment": self.start_segment, "position": 0, "mark": ""}
        if self._bytes(self.start_segment, self.start_position - 1, self.start_position) != b"\n":
            raise ValueError(f"no line of {self.start_segment} begins at {self.start_position}")
        return {"segment": self.start_segment, "position": self.start_position, "mark": self.mark(self.start_segment, self.start_position)}

    def latest(self) -> dict:
        sizes = self.sizes()
        if not sizes or segment_order(list(sizes)[-1]) < segment_order(self.start_segment):
            return self.first()
        segment = list(sizes)[-1]
        position = self.last_line_end(segment, sizes[segment])
        if segment == self.start_segment and position < self.start_position:
            raise RuntimeError(f"segment {segment} ends at {position}, before the start position {self.start_position}")
        return {"segment": segment, "position": position, "mark": self.mark(segment, position)}

    def _check(self, place: dict, sizes: dict[str, int]) -> None:
        segment, position = place["segment"], place["position"]
        if segment not in sizes:
            raise RuntimeError(f"segment {segment} is gone; it was read up to {position}")
        if sizes[segment] < position:
            raise RuntimeError(f"segment {segment} was truncated: {sizes[segment]} bytes, read up to {position}")
        if self.mark(segment, position) != place["mark"]:
            raise RuntimeError(f"segment {segment} is not the one that was read up to {position}")

    def pieces(self, start: dict, end: dict) -> list[Piece]:
        if start == end:
            return []
        low, high = segment_order(start["segment"]), segment_order(end["segment"])
        if (low, start["position"]) > (high, end["position"]):
            raise RuntimeError(f"the feed ends at {end['segment']}:{end['position']}, before {start['segment']}:{start['position']}")
        sizes = self.sizes()
        self._check(end, sizes)
        if start["segment"] in sizes or (start["position"] and self.missing == "error"):
            self._check(start, sizes)
        out = []
        for segment, size in sizes.items():
            if low <= segment_order(segment) <= high:
                begin = start["position"] if segment == start["segment"] else 0
                stop = end["position"] if segment == end["segment"] else size
                cuts = [*range(begin, stop, self.bytes_per_task), stop]
                out += [Piece(segment, a, b, stop, a == begin) for a, b in zip(cuts, cuts[1:])]
        return out

    def lines(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        where, root = self._open()
        at, positions, values, held = piece.begin, [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([piece.segment] * len(values), pa.string()), pa.array(positions, pa.int64()), pa.array(values, pa.string())], ["segment", "position", "value"]
            )

        with where.open_input_file(f"{root}/{piece.segment}") as raw:
            if raw.size() < piece.stop:
                raise RuntimeError(f"segment {piece.segment} was truncated: {raw.size()} bytes, {piece.stop} wanted")
            file = io.BufferedReader(raw, 1 << 20)
            file.seek(at if piece.whole_line else at - 1)
            if not piece.whole_line:
                # The line that runs into this piece belongs to the piece before.
                at += len(file.readline(piece.stop - at + 1)) - 1
            while at < piece.end:
                line = file.readline(piece.stop - at)
                positions.append(at)
                values.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                at, held = at + len(line), held + len(line)
                if held > BATCH_BYTES:
                    yield batch()
                    positions, values, held = [], [], 0
        if values:
            yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = SegmentFolder(options)

    def initialOffset(self) -> dict:  # noqa: N802 - names of the data source interface
        return self.folder.first()

    def latestOffset(self) -> dict:  # noqa: N802
        return self.folder.latest()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.folder.pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class _Once(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = SegmentFolder(options)

    def partitions(self) -> list[Piece]:
        # Spark wants at least one partition.
        return self.folder.pieces(self.folder.first(), self.folder.latest()) or [Piece("", 0, 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition) if partition.segment else iter(())


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Once:
        return _Once(dict(self.options))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options))


def _reader(spark: SparkSession, reader, path: str, options: dict) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(SegmentSource)
    return reader.format("segments").options(path=path, **{k: v for k, v in options.items() if v is not None}).load()


def segment_stream(
    spark: SparkSession, path: str, start_segment: str | None = None, start_position: int | None = None, bytes_per_task: int | None = None, missing: str = "error"
) -> DataFrame:
    """Stream of the lines of the text segments below ``path``: segment, position (of the line's first byte), value.

    The newest segment may still grow: its last line is taken once its line feed is there. A segment is complete once a later
    one exists, and then its last line needs no line feed. The query's checkpoint holds one place, (segment, byte position), so
    it stays small however many segments there were; ``start_segment`` and ``start_position``, where a line must begin, count
    only for a query without a checkpoint. A batch takes all that is new, cut every ``bytes_per_task`` bytes, so a large segment
    is many tasks. A segment that became shorter than what was read of it, or is another file, stops the query. So does the
    segment read last if it is gone; with ``missing="skip"`` the feed goes on with the next one. Bytes that are not UTF-8 are
    replaced; an empty line is an empty value. ``path`` is a file system that Arrow knows.
    """
    return _reader(spark, spark.readStream, path, dict(start_segment=start_segment, start_position=start_position, bytes_per_task=bytes_per_task, missing=missing))


def segment_lines(spark: SparkSession, path: str, start_segment: str | None = None, start_position: int | None = None, bytes_per_task: int | None = None) -> DataFrame:
    """What ``segment_stream`` would give now, as a table."""
    return _reader(spark, spark.read, path, dict(start_segment=start_segment, start_position=start_position, bytes_per_task=bytes_per_task))
