"""An append-aware line source: ``spark.readStream.format("line_tail").option("path", p)``.

Spark's file sources track files; this one tracks bytes of one growing file on a shared mount. Offsets are bytes after a line's
end, so multi-byte text survives restarts, and an unfinished last line waits for its end. A batch's bytes are cut into ranges that
executors read in parallel; a range holds the lines that start in it.

Options: path; strategy (streams: EARLIEST, COMMITED: from the start, then from the checkpoint; LATEST: what is appended after the start; batches:
ONCE_EARLIEST, ONCE_LATEST); rangeBytes.
A file that is shorter than the offset was replaced and is read from its start; a missing file is empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from rivulet.exceptions import ConfigurationError

BLOCK = 1 << 16


def complete(path: str) -> int:
    """Bytes up to the end of the last finished line. A last \\r is unfinished: a \\n may follow."""
    try:
        size = os.path.getsize(path)
    except OSError:
        return 0
    with open(path, "rb") as f:
        at, last = size, True
        while at > 0:
            lo = max(0, at - BLOCK)
            f.seek(lo)
            data = f.read(at - lo)
            n = len(data) - 1 if last and data.endswith(b"\r") else len(data)
            end = max(data.rfind(b"\n", 0, n), data.rfind(b"\r", 0, n))
            if end >= 0:
                if data[end : end + 1] == b"\r" and lo + end + 1 < size and not data[end + 1 : end + 2]:
                    f.seek(lo + end + 1)
                    return lo + end + 1 + (f.read(1) == b"\n")
                return lo + end + 1
            at, last = lo, False
    return 0


_END = re.compile(rb"\r\n|\n|\r")


def lines(path: str, start: int, first: int, stop: int, end: int) -> Iterator[str]:
    """Lines of the batch [start, end) that begin in [first, stop). Reads on past stop to the last line's end only, a block at a time."""
    inside = first == start
    at = first if inside else first - 1  # the line end before the first line may be the byte before
    with open(path, "rb") as f:
        f.seek(at)
        data, i, scan = b"", 0, 0  # data[i:] begins at byte at; scan: where to look for its end
        while inside and at < stop or not inside:
            m = _END.search(data, scan)
            rest = end - at - (len(data) - i)  # bytes of the batch that aren't read yet
            if m and (m.end() < len(data) or m.group() != b"\r" or rest <= 0):
                if inside:
                    yield data[i : m.start()].decode("utf-8", "replace")
                at += m.end() - i
                i = scan = m.end()
                inside = True
                continue
            more = f.read(min(BLOCK, rest)) if rest > 0 else b""
            if not more:
                if inside and i < len(data):
                    yield data[i:].decode("utf-8", "replace")
                return
            scan = max(i, len(data) - 1) - i
            data, i = data[i:] + more, 0


class Range(InputPartition):
    def __init__(self, *values: int):
        self.values = values


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, strategy: str, range_bytes: int):
        self.path, self.strategy, self.range_bytes = path, strategy, range_bytes

    def initialOffset(self) -> dict:
        return {"pos": complete(self.path) if self.strategy == "LATEST" else 0}

    def latestOffset(self) -> dict:
        return {"pos": complete(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        a, b = start["pos"], end["pos"]
        a = 0 if b < a else a
        cuts = [*range(a, b, self.range_bytes), b]
        return [Range(a, x, y, b) for x, y in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[tuple[str]]:
        for line in lines(self.path, *partition.values):
            yield (line,)

    def commit(self, end: dict) -> None:
        pass


class OnceReader(DataSourceReader):
    """The lines that are finished now, or none."""

    def __init__(self, path: str, strategy: str, range_bytes: int):
        self.reader, self.empty = LineReader(path, "EARLIEST", range_bytes), strategy == "ONCE_LATEST"

    def partitions(self) -> list[Range]:
        return [] if self.empty else self.reader.partitions({"pos": 0}, self.reader.latestOffset())

    def read(self, partition: Range | None) -> Iterator[tuple[str]]:
        return self.reader.read(partition) if partition else iter(())


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "value string"

    def _options(self, known: tuple[str, ...]) -> tuple[str, str, int]:
        path, strategy = self.options.get("path", "").strip(), self.options.get("strategy", known[0])
        if not path:
            raise ConfigurationError("line_tail needs a path")
        if strategy not in known:
            raise ConfigurationError(f"{strategy} is none of {', '.join(known)}")
        return path, strategy, int(self.options.get("rangeBytes", 64 << 20))

    def streamReader(self, schema) -> LineReader:
        return LineReader(*self._options(("COMMITED", "EARLIEST", "LATEST")))

    def reader(self, schema) -> OnceReader:
        return OnceReader(*self._options(("ONCE_EARLIEST", "ONCE_LATEST")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTail)


def read_once(spark: SparkSession, path: str, strategy: str = "ONCE_EARLIEST") -> DataFrame:
    """What is there now, once: all finished lines for ONCE_EARLIEST, none for ONCE_LATEST; an unfinished last line is held back."""
    register(spark)
    return spark.read.format("line_tail").option("path", path).option("strategy", strategy).load()
