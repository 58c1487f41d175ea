"""Files that grow: a streaming source with a byte offset per file.

``spark.readStream.format("growing_lines").option("path", folder)`` gives (file, line, value) of the lines appended to the files of a folder; ``line`` is
the byte at which a line begins, so it orders a file's lines over all batches. An offset holds, per file, how far it has been read, always behind
a line end: a line that is still being written waits for its end. What a trigger finds is cut into pieces of
``pieceBytes`` that tasks read; a line belongs to the piece it begins in. Files only grow; one that becomes shorter is left alone until it is
longer again. Names that begin with a dot or an underscore are no data. With ``until``, files are read no further than so many bytes.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 32 << 20
TAIL = 1 << 16
LINES = 10_000  # in a batch


@dataclass
class Piece(InputPartition):
    file: str
    first: int  # the bytes [first, last) of the range [begin, end) between two offsets
    last: int
    begin: int
    end: int


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def last_line_end(handle, begin: int, end: int) -> int:
    """The place behind the last line end in the bytes [begin, end), or ``begin``."""
    while end > begin:
        low = max(begin, end - TAIL)
        handle.seek(low)
        at = handle.read(end - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        end = low
    return begin


def lines_between(handle, piece: Piece) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that begin in a piece."""
    at = piece.first
    rest = b""
    if at > piece.begin:  # the line that covers the byte before belongs to the piece before, unless it ends there
        at -= 1
    handle.seek(at)
    skip = at < piece.first
    read = at
    while at < piece.last:
        parts = [rest]
        while read < piece.end:
            block = handle.read(min(TAIL, piece.end - read))
            read += len(block)
            parts.append(block)
            if b"\n" in block or not block:
                break
        *whole, rest = b"".join(parts).split(b"\n")
        if not whole:
            return
        for line in whole:
            if at >= piece.last:
                return
            if not skip:
                yield at, line.decode("utf-8", "replace").removesuffix("\r")
            skip = False
            at += len(line) + 1


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.size = int(options.get("pieceBytes", PIECE))
        self.until = int(options["until"]) if "until" in options else None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = _file_system(self.path)
        ends = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._":
                size = info.size if self.until is None else min(info.size, self.until)
                with system.open_input_file(info.path) as handle:
                    if end := last_line_end(handle, 0, size):
                        ends[info.path] = end
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for file, last in sorted(after.items()):
            begin = before.get(file, 0)
            out += [Piece(file, at, min(at + self.size, last), begin, last) for at in range(begin, last, self.size)]
        return out

    def read(self, partition: Piece) -> Iterator:
        import pyarrow as pa

        system, _ = _file_system(self.path)
        with system.open_input_file(partition.file) as handle:
            lines = lines_between(handle, partition)
            while some := list(itertools.islice(lines, LINES)):
                places, values = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(some), pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "line", "value"])


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, line long, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def growing_lines(spark: SparkSession, path: str, **options: object):
    """(file, line, value) as a stream of the lines appended to the files of a folder."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
