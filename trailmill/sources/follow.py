"""Lines of growing logs: a data source that reads files by ranges of bytes, once or as they grow.

`session_lines` has session (the file's path), line (the byte that the line begins at, which
orders lines) and value.  As a stream its offset is how far each file has been read, up to
its last complete line: a line that is still being written waits for its end, and a file
that is appended to gives its new lines only.  Files are read through the store that their
URI names, so driver and executors must both reach it.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "session_lines"
#: Bytes of one range, and bytes looked at together for the end of the last line.
RANGE, TAIL = 64 << 20, 64 << 10


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str, glob: str) -> dict[str, int]:
    """Sizes of the files below `path` that match; transcripts of subagents are left out."""
    store, base = _store(path)
    if store.get_file_info(base).type == pyarrow.fs.FileType.NotFound:
        return {}
    found = store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    return {f.path: f.size for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob) and "/subagents/" not in f.path}


def last_line_end(store: pyarrow.fs.FileSystem, file: str, start: int, size: int) -> int:
    """The place after the last newline between `start` and `size`, or `start` where there is none."""
    with store.open_input_file(file) as source:
        end = size
        while end > start:
            begin = max(start, end - TAIL)
            at = source.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))


def ranges(files: dict[str, tuple[int, int]]) -> list[Range]:
    return [Range(f, a, min(a + RANGE, end)) for f, (start, end) in sorted(files.items()) for a in range(start, end, RANGE)]


def lines_of(root: str, part: Range) -> Iterator[tuple[str, int, str]]:
    """The lines that begin in a range; bytes that are no UTF-8 are replaced."""
    file, start, end = part.value
    store, _ = _store(root)
    with store.open_input_file(file) as raw_file, io.BufferedReader(raw_file, 1 << 20) as source:
        at = start
        if start:  # a line that began before is another range's
            source.seek(start - 1)
            at += len(source.readline()) - 1
        source.seek(at)
        while at < end and (raw := source.readline()):
            yield file, at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(raw)


class SessionLines(DataSource):
    """Options: path, and glob (by default `*.jsonl`)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "session string, line long, value string"

    def reader(self, schema: StructType) -> "WholeReader":
        return WholeReader(self.options)

    def streamReader(self, schema: StructType) -> "GrowingReader":
        return GrowingReader(self.options)


class WholeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")

    def partitions(self) -> list[Range]:
        return ranges({f: (0, n) for f, n in listed(self.path, self.glob).items()})

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        if partition is not None and partition.value is not None:  # Spark asks for one empty part of no files
            yield from lines_of(self.path, partition)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        store, _ = _store(self.path)
        for file, size in listed(self.path, self.glob).items():
            before = self.known.get(file, 0)
            if size > before:
                self.known[file] = last_line_end(store, file, before, size)
        return {f: n for f, n in self.known.items() if n}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return ranges({f: (start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)})

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        return lines_of(self.path, partition)

    def commit(self, end: dict[str, int]) -> None:
        pass


def session_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """The lines of all files below `path`."""
    spark.dataSource.register(SessionLines)
    return spark.read.format(NAME).option("path", path).option("glob", glob).load()


def follow(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """A stream of the lines of the files below `path` as they grow."""
    spark.dataSource.register(SessionLines)
    return spark.readStream.format(NAME).option("path", path).option("glob", glob).load()
