"""A streaming source of lines appended to files, by byte positions.

Spark's file stream reads a file once; a log goes on growing. Here the offset is how far each file has been read,
always to the end of a line, so that a line comes once, when it is complete, also after a restart.
"""

from __future__ import annotations

import json
import posixpath
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 16


class _Range(InputPartition):
    """The lines of ``path`` that begin in the bytes ``low`` to ``high``."""

    def __init__(self, path: str, low: int, high: int, first: bool, end: int):
        self.path, self.low, self.high, self.first, self.end = path, low, high, first, end


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def _line_end(files: fs.FileSystem, path: str, low: int, size: int, objects: bool) -> int:
    """Where the last complete line before ``size`` ends, at least ``low``; with ``objects`` a whole JSON object needs no line feed."""
    end, at = low, size
    with files.open_input_file(path) as f:
        while at > low:
            begin = max(low, at - _BLOCK)
            place = f.read_at(at - begin, begin).rfind(b"\n")
            if place >= 0:
                end = begin + place + 1
                break
            at = begin
        if objects and 0 < size - end <= _BLOCK * 16:
            try:
                json.loads(f.read_at(size - end, end))
                end = size
            except ValueError:  # still being written
                pass
    return end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.objects = options.get("objects", "false") == "true"
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, top = _folder(self.path)
        found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        now = {}
        for f in found:
            name = f.path.removeprefix(top).lstrip("/")
            if f.type == fs.FileType.File and name.endswith(self.suffix) and not posixpath.basename(name).startswith((".", "_")):
                begin = self.known.get(name, 0)
                now[name] = _line_end(files, f.path, begin if begin <= f.size else 0, f.size, self.objects)
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for name, high in sorted(end.items()):
            low = start.get(name, 0)
            low = low if low <= high else 0  # the file was begun anew
            out += [_Range(name, a, min(a + self.bytes, high), a == low, high) for a in range(low, high, self.bytes)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        files, top = _folder(self.path)
        places, lines = [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([part.path] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "position", "line"])
            places.clear(), lines.clear()
            return out

        with files.open_input_file(posixpath.join(top, part.path)) as f:
            skip = not part.first  # then the line that began before isn't this range's
            at = begin = part.low - skip
            rest: list[bytes] = []
            while at < part.end and (skip or begin < part.high):
                got = f.read_at(min(_BLOCK * 16, part.end - at), at)
                if not got:
                    break
                at += len(got)
                *whole, last = got.split(b"\n")
                for line in whole:
                    line, rest = b"".join([*rest, line]), []
                    if not skip and begin < part.high:
                        places.append(begin), lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    skip = False
                    begin += len(line) + 1
                rest.append(last)
                if len(lines) >= 5000:
                    yield batch()
            if not skip and begin < part.high and any(rest):  # a last line without a line feed
                places.append(begin), lines.append(b"".join(rest).decode("utf-8", "replace"))
        yield batch()

    def commit(self, end: dict) -> None:
        """Offsets are kept in the query's checkpoint."""


class AppendedLines(DataSource):
    """``file, position, line`` of the complete lines in the files below ``path`` (local, or a store that pyarrow can open).

    Options: ``suffix`` of file names, ``partitionBytes`` of a task, ``objects`` (``true``: lines are JSON, so that one is
    complete without a line feed too). A file that got shorter is read from its beginning;
    names that begin with a dot or underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def appended_lines(spark: SparkSession, path: str, suffix: str = "", partition_bytes: int = 64 << 20, objects: bool = False) -> DataFrame:
    """The stream of lines below ``path``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the source's processes may not find the package
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").options(suffix=suffix, partitionBytes=partition_bytes, objects=str(objects).lower()).load(path)
