"""A log file as a data source: lines by byte offset, read in byte ranges, and followed as a stream.

``spark.dataSource.register(LogSource)``, then
``spark.read.format("log_bytes").option("path", ...).option("offset", n).load()``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tesserae.sources.storage import opened

#: Bytes of a partition, and of one look at the file.
RANGE, LOOK = 32 << 20, 1 << 20


@dataclass
class Span(InputPartition):
    """Lines that begin from ``start`` to ``end`` (exclusive); ``first`` marks one whose start is a line's, or is taken for one."""

    start: int
    end: int
    first: bool


def size(path: str) -> int:
    store, at = opened(path)
    info = store.get_file_info(at)
    return info.size or 0 if info.is_file else 0


def complete(path: str, least: int) -> int:
    """Where the last complete line ends, at least ``least``: looked for backwards from the end of the file."""
    store, at = opened(path)
    end = size(path)
    if end <= least:
        return least
    with store.open_input_file(at) as f:
        while end > least:
            start = max(least, end - LOOK)
            f.seek(start)
            found = f.read(end - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return least


def spans(start: int, end: int, length: int) -> list[Span]:
    return [Span(s, min(s + length, end), s == start) for s in range(start, end, length)]


def lines(path: str, span: Span, most: int | None = None) -> Iterator[tuple[int, str]]:
    """Offset and text (without its newline) of each line that begins within the span, at most ``most``.

    A line that crosses the span's end is read to its own end; the next span, which
    begins within it, passes over it.  Bytes that are no UTF-8 are replaced.
    """
    store, at = opened(path)
    with store.open_input_file(at) as f:
        place = span.start if span.first else span.start - 1
        f.seek(place)
        rest, passing = b"", not span.first
        given = 0
        while True:
            part = f.read(LOOK)
            if not part:
                break
            rest += part
            *whole, rest = rest.split(b"\n")
            for line in whole:
                if passing:
                    passing = False
                elif place >= span.end or given == most:
                    return
                else:
                    yield place, line.decode("utf-8", "replace")
                    given += 1
                place += len(line) + 1
            if not passing and place >= span.end:
                return
        if rest and not passing and place < span.end and given != most:
            yield place, rest.decode("utf-8", "replace")


class LogSource(DataSource):
    """Options: ``path``; ``offset``, the byte to begin at (0); ``limit``, the most lines of a batch; ``range``, bytes of a partition.

    A batch gives what a slice of the file from ``offset`` would: its first line
    is the rest of the line there.  A stream gives complete lines only, so one that is
    still being written comes once it ends.
    """

    @classmethod
    def name(cls) -> str:
        return "log_bytes"

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.offset = options["path"], int(options.get("offset", 0))
        self.length = int(options.get("range", RANGE))
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> Sequence[Span]:
        if self.limit is not None:  # few lines: one look instead of all partitions
            return [Span(self.offset, max(size(self.path), self.offset), True)]
        return spans(self.offset, size(self.path), self.length) or [Span(self.offset, self.offset, True)]

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        if partition.start < partition.end:
            yield from lines(self.path, partition, self.limit)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.offset = options["path"], int(options.get("offset", 0))
        self.length = int(options.get("range", RANGE))
        self.seen = self.offset

    def initialOffset(self) -> dict:
        return {"bytes": self.offset}

    def latestOffset(self) -> dict:
        self.seen = complete(self.path, self.seen)
        return {"bytes": self.seen}

    def partitions(self, start: dict, end: dict) -> Sequence[Span]:
        self.seen = max(self.seen, end["bytes"])
        return spans(start["bytes"], end["bytes"], self.length)

    def read(self, partition: Span) -> Iterator[tuple[int, str]]:
        yield from lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """The file itself keeps everything."""
