"""Ledgers as a stream: files that grow, read from the byte where the last batch ended.

An offset is a byte a file, always behind a line's end. What stands behind the last line's end is a torn
tail: it is left for the batch in which its line has ended, so no half line is ever read. A file's first
line names its version; those of an unknown version, or of none, are named once and never read. A file is
read in ranges, each the lines that begin in it; a task takes ranges of one file or many until they have ``TASK`` bytes.

``append_line`` adds to a ledger as the protocol wants: a new file gets its version and column lines, a
torn tail is ended first, and a file of an unknown version is refused.

Defined results: a file that has become shorter than what was read of it fails the stream, for its rows
can no longer be told apart; an empty file, or one whose first line has not ended, is not there yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomshed.sources import records
from loomshed.sources.trees import STAGE, opened

#: Bytes of a range of a file, those of the ranges that one task reads, and those that are read at a time.
RANGE, TASK, BLOCK = 64 << 20, 8 << 20, 1 << 20
LINES = "manifest string, n long, line string, torn boolean, head string"


@dataclass(frozen=True)
class Range:
    """The lines of a file that begin in [start, stop)."""

    path: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """The ranges of a task."""

    held: list[Range]

    def __post_init__(self):
        super().__init__(tuple(self.held))


def _last_end(fs: pafs.FileSystem, path: str, start: int, size: int) -> int:
    """The byte behind the last line's end of [start, size), or ``start`` where none ends there."""
    with fs.open_input_file(path) as f:
        stop = size
        while stop > start:
            at = max(stop - BLOCK, start)
            found = f.read_at(stop - at, at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            stop = at
    return start


def _line(f, at: int) -> bytes:
    """The line that begins at a byte, without its end."""
    out = b""
    while block := f.read_at(BLOCK, at + len(out)):
        end = block.find(b"\n")
        if end >= 0:
            return out + block[:end]
        out += block
    return out


class LedgerReader(DataSourceStreamReader):
    """Offsets by file, and the lines between two of them."""

    def __init__(self, options: dict):
        self.root, self.range = options["path"], int(options.get("range", RANGE))
        self.held: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = opened(self.root)
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if not info.is_file or info.base_name.startswith((".", "_")) or f"/{STAGE}" in info.path:
                continue
            start = self.held.get(info.path, 0)
            if info.size < start:
                raise ValueError(f"{info.path} has become shorter than the {start} bytes that were read")
            if info.size > start and (end := _last_end(fs, info.path, start, info.size)) > start:
                self.held[info.path] = end
        return dict(self.held)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.held = {**self.held, **end}
        out, size = [], TASK
        for path, stop in sorted(end.items()):
            for at in range(start.get(path, 0), stop, self.range):
                if size >= TASK:
                    out.append([])
                    size = 0
                out[-1].append(Range(path, at, min(at + self.range, stop)))
                size += out[-1][-1].stop - at
        return [Ranges(held) for held in out]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        fs, _ = opened(self.root)
        for part in partition.held:
            yield from self._lines(fs, part)

    def _lines(self, fs: pafs.FileSystem, partition: Range) -> Iterator[tuple]:
        with fs.open_input_file(partition.path) as f:
            head = _line(f, 0)
            at = partition.start
            if at and f.read_at(1, at - 1) != b"\n":  # the line that is under way is the range's before
                at += len(_line(f, at)) + 1
            rest = b""
            while at < partition.stop:
                block = f.read_at(BLOCK, at + len(rest))
                lines = (rest + block).split(b"\n")
                if not block:
                    return
                rest = lines.pop()
                for line in lines:
                    if at >= partition.stop:
                        return
                    n = 0 if at == 0 else 1 if at == len(head) + 1 else 2
                    yield partition.path, n, line.decode("utf-8", "replace").rstrip("\r"), False, head.decode("utf-8", "replace").rstrip("\r")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class Ledgers(DataSource):
    """Spark's name for the stream."""

    @classmethod
    def name(cls) -> str:
        return "loomshed_ledger"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LedgerReader(dict(self.options))


def stream_ledger(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of the ledgers below a folder, as streams; the rules are those of ``records.read_ledger``."""
    spark.dataSource.register(Ledgers)
    lines = spark.readStream.format("loomshed_ledger").options(path=path, **options).load()
    return records.ledger_rows(lines)


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> None:
    """Append to ``out`` the rows, and to ``out``-rejects the lines that are none, that have come since the last call."""
    rows, bad = stream_ledger(spark, path, **options)
    started = [
        df.writeStream.format("parquet").option("path", f"{out}{tail}").option("checkpointLocation", f"{checkpoint}{tail}").trigger(
            availableNow=True
        ).start()
        for df, tail in ((rows, ""), (bad, "-rejects"))
    ]
    for query in started:
        query.awaitTermination()


def append_line(path: str, row: dict[str, object]) -> None:
    """One row at the end of a ledger of any known version, which keeps its shape; a new ledger is of the newest."""
    fs, file = opened(path)
    columns = records.LEDGER[0]
    info = fs.get_file_info(file)
    version, n = list(records.LEDGER_VERSIONS.items())[-1]
    text = ""
    if info.type == pafs.FileType.NotFound or not info.size:
        text = f"{version}\n{records.TAB.join(columns[:n])}\n"
    else:
        with fs.open_input_file(file) as f:
            head = _line(f, 0).decode("utf-8", "replace").rstrip("\r")
            if head not in records.LEDGER_VERSIONS:
                raise ValueError(f"the ledger begins with {head!r}, which is no known version")
            n = records.LEDGER_VERSIONS[head]
            text = "" if f.read_at(1, info.size - 1) == b"\n" else "\n"
    text += records.TAB.join("" if row.get(c) is None else str(row[c]) for c in columns[:n]) + "\n"
    with fs.open_append_stream(file) as out:
        out.write(text.encode())


def told(spark: SparkSession, out: str, tail: str = "") -> DataFrame:
    """What ``follow`` has appended; nothing where it has not told anything."""
    kinds = ", ".join(f"{c} {k}" for c, k in zip(*records.LEDGER, strict=True)) if not tail else "n long, line string, reason string"
    return spark.read.schema(f"manifest string, {kinds}").parquet(f"{out}{tail}")
