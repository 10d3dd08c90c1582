"""Growing files of lines as a streaming source with byte offsets of its own.

spark.readStream.format("line_tail").option("path", folder).load() gives (file, at, line): at is the byte where the line begins.
A batch ends behind the last line feed of every file, so a line that is still being written waits for a later one.  The offsets are
the bytes read of every file, kept in the query's checkpoint: a restarted query goes on where it was.  A file that is shorter than
what was read of it, or gone, fails the query.  Large ranges are split, so one file's growth is read by many tasks; the growth of many
small files is read by one task, up to the bytes of a range and FILES files.

Options: path (a folder or one file, a local path or a URI that all executors reach), suffix of the files below a folder
(.jsonl), split (bytes of a range, 33554432).
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_BLOCK, _BACK = 4 << 20, 1 << 16
#: Files that a task reads at most; threads that look at files for the driver.
FILES, LOOKERS = 1024, 16
SCHEMA = "file string, at long, line string"


class Truncated(ValueError):
    """A file is shorter than what was read of it."""


@dataclass
class _Range:
    """The lines of a file that begin in [lo, hi); whole: a line begins at lo."""

    file: str
    lo: int
    hi: int
    whole: bool


@dataclass
class _Ranges(InputPartition):
    """What one task reads."""

    ranges: list[_Range] = field(default_factory=list)


def whole_lines(files: fs.FileSystem, path: str, size: int) -> int:
    """The offset behind the last line feed among the first size bytes of a file."""
    with files.open_input_file(path) as source:
        hi = size
        while hi > 0:
            lo = max(0, hi - _BACK)
            found = source.read_at(hi - lo, lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            hi = lo
    return 0


class _Lines:
    """Listing and reading of the files of one source."""

    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.split = options["path"], options.get("suffix", ".jsonl"), int(options.get("split", 32 << 20))

    def ends(self, known: dict[str, tuple[int, int]]) -> dict[str, int]:
        """The offset of whole lines of every file; known holds (size, end) of files and is brought up to date."""
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        if found.type == fs.FileType.Directory:
            listed = [f for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(self.suffix)]
        else:
            listed = [found] if found.type == fs.FileType.File else []
        grown = [f for f in listed if known.get(f.path, (-1, 0))[0] != f.size]
        with ThreadPoolExecutor(LOOKERS) as pool:
            for f, end in zip(grown, pool.map(lambda f: whole_lines(files, f.path, f.size), grown), strict=True):
                known[f.path] = (f.size, end)
        return {f.path: known[f.path][1] for f in listed}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[_Ranges]:
        for file, lo in start.items():
            if end.get(file, 0) < lo:
                raise Truncated(f"{file} was truncated: {lo} bytes are read, {end.get(file, 0)} bytes of whole lines are there")
        out, room = [], 0
        for file, hi in sorted(end.items()):
            lo = start.get(file, 0)
            for a in range(lo, hi, self.split):
                part = _Range(file, a, min(a + self.split, hi), a == lo)
                room -= part.hi - part.lo
                if not out or room < 0 or len(out[-1].ranges) == FILES:
                    out.append(_Ranges())
                    room = self.split - (part.hi - part.lo)
                out[-1].ranges.append(part)
        return out

    def batches(self, task: _Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        names, places, lines, size = [], [], [], 0
        for part in task.ranges:
            for at, some in self._read(files, part):
                names += [part.file] * len(some)
                places += at
                lines += some
                size += sum(map(len, some))
                if size >= _BLOCK:
                    yield self._batch(names, places, lines)
                    names, places, lines, size = [], [], [], 0
        if lines:
            yield self._batch(names, places, lines)

    def _read(self, files: fs.FileSystem, part: _Range) -> Iterator[tuple[list[int], list[bytes]]]:
        """The places and bytes of the lines of a range, by block."""
        with files.open_input_file(part.file) as source:
            at = part.lo
            if not part.whole:  # the line that begins before lo is the range before's
                at = self._behind(source, part.lo - 1)
            held, base, pos = b"", at, at
            while base < part.hi:
                block = source.read_at(min(_BLOCK, max(_BACK, part.hi - pos)), pos)
                pos += len(block)
                held += block
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield self._split(part, held[:cut], base)
                    held, base = held[cut:], base + cut
                if not block:
                    break

    @staticmethod
    def _behind(source, at: int) -> int:
        """The offset behind the first line feed at or after a byte."""
        while block := source.read_at(_BACK, at):
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return at

    @staticmethod
    def _split(part: _Range, data: bytes, base: int) -> tuple[list[int], list[bytes]]:
        lines, places, at = [], [], base
        for line in data.split(b"\n")[:-1]:
            if at >= part.hi:
                break
            lines.append(line)
            places.append(at)
            at += len(line) + 1
        return places, lines

    @staticmethod
    def _batch(names: list[str], places: list[int], lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())], ["file", "at", "line"])


class _StreamReader(_Lines, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends(self.known)

    def partitions(self, start: dict, end: dict) -> list[_Ranges]:
        return self.ranges(start, end)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class _BatchReader(_Lines, DataSourceReader):
    def partitions(self) -> list[_Ranges]:
        return self.ranges({}, self.ends({})) or [_Ranges()]

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class LineTail(DataSource):
    """The source; a batch read gives all whole lines that are there."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(LineTail)
