"""Reading logs from a byte on (SRC1): ranges of files as rows, and a stream whose offsets are (file, byte).

A range is (file, low, high): the lines that begin in it, read to their ends. A line
belongs to the range its first byte lies in, so one huge file is many tasks and no line is
read twice. `high` of a file's last range is its listed length, whatever is appended while it is read; a last line
without its newline is left for the next reading. `line_seq` is the byte at which a line begins, the same in
every sweep.

Paths are opened by pyarrow's file systems: what the listing names, in a store it knows or on a
disk every executor has.
"""

from __future__ import annotations

import fnmatch
import string
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20
#: Bytes read at a time, and held before they are handed on.
BLOCK = 1 << 20
_BOM = b"\xef\xbb\xbf"
LINES = "value string, source_file string, line_start bigint, line_seq bigint, line_end bigint"


class Blocks:
    """A file read in blocks from one place on; `taken` counts the bytes."""

    def __init__(self, file: pa.NativeFile, at: int, end: int, block: int = BLOCK):
        self.file, self.at, self.end, self.block, self.taken = file, at, end, block, 0
        self.file.seek(at)

    def next(self) -> bytes:
        data = self.file.read(min(self.block, self.end - self.at))
        self.at += len(data)
        self.taken += len(data)
        return data


def lines_between(blocks: Blocks, low: int, high: int, first: int) -> Iterator[tuple[bytes, int, int]]:
    """(line, its first byte, the byte after its newline) of the lines that begin in [low, high).

    `first` is where the file's reading starts: a line begins there. `blocks` start at `max(first, low - 1)`.
    """
    begin, held, skipping = blocks.at, b"", low > first
    while True:
        data = blocks.next()
        if not data:
            return  # what is held has no newline yet
        parts = (held + data).split(b"\n")
        for line in parts[:-1]:
            end = begin + len(line) + 1
            if not skipping:
                if begin >= high:
                    return
                yield line, begin, end
            skipping, begin = False, end
        if begin >= high:
            return
        held = parts[-1]
        if skipping:
            begin, held = begin + len(held), b""


def _opened(path: str) -> pa.NativeFile:
    # A listed path is a URI but for its characters beyond ASCII.
    system, inner = pafs.FileSystem.from_uri(quote(path, safe=string.printable.strip()) if ":" in path else path)
    return system.open_input_file(inner)


def _rows(path: str, low: int, high: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
    values, begins, ends, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_pydict({
            "value": pa.array(values, pa.string()), "source_file": pa.array([path] * n, pa.string()), "line_start": pa.array([low] * n, pa.int64()),
            "line_seq": pa.array(begins, pa.int64()), "line_end": pa.array(ends, pa.int64())})

    with _opened(path) as file:
        for line, begin, end in lines_between(Blocks(file, max(first, low - 1), length), low, high, first):
            if begin == 0 and line.startswith(_BOM):
                line = line[len(_BOM):]
            values.append(line.decode("utf-8", "replace"))
            begins.append(begin)
            ends.append(end)
            held += len(line) + 64
            if held >= BLOCK:
                yield batch()
                values, begins, ends, held = [], [], [], 0
    if values:
        yield batch()


def tasks_of(spark: SparkSession) -> int:
    """Tasks for rows that are few and each much work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_from(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Complete lines (value, source_file, line_start, line_seq, line_end) of files (source_file, first, length) from byte `first` on."""
    step = F.lit(range_bytes).cast("bigint")
    ranges = files.where("length > first").select(
        "source_file", "first", "length", F.explode(F.sequence(F.col("first"), F.col("length") - 1, step)).alias("low"))
    ranges = ranges.withColumn("high", F.least(F.col("low") + step, F.col("length")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _rows(r["source_file"], r["low"], r["high"], r["first"], r["length"])

    # Ranges are few and each is much work: a task for every few of them.
    return ranges.repartition(tasks_of(files.sparkSession), "source_file", "low").mapInArrow(read, LINES)


def _last_newline(path: str, first: int, length: int, block: int = BLOCK) -> int:
    """The byte after the last newline in [first, length), or `first`."""
    with _opened(path) as file:
        high = length
        while high > first:
            low = max(first, high - block)
            file.seek(low)
            at = file.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return first


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int, first: int, length: int):
        self.path, self.low, self.high, self.first, self.length = path, low, high, first, length


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {file: byte after the last complete line taken}; a file that became shorter starts again."""

    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.sizes: dict[str, int] = {}

    def _listed(self) -> dict[str, int]:
        system, inner = pafs.FileSystem.from_uri(self.path)
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        return {scheme + f.path: f.size for f in system.get_file_info(pafs.FileSelector(inner, recursive=True))
                if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = {}
        for path, size in self._listed().items():
            before, taken = self.sizes.get(path, (-1, 0))
            if size != before:
                # Only what was appended is looked through for a newline.
                taken = _last_newline(path, taken if size >= taken else 0, size)
            self.sizes[path] = (size, taken)
            found[path] = taken
        return found

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, high in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if high < first else first
            out += [Range(path, low, min(low + self.step, high), first, high) for low in range(first, high, self.step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from _rows(part.path, part.low, part.high, part.first, part.length)


class LogSource(DataSource):
    """Options: path, glob, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def stream(spark: SparkSession, path: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """New complete lines of growing files; the query's checkpoint holds how far each was read."""
    spark.dataSource.register(LogSource)
    return (spark.readStream.format("log_tail").option("path", path).option("glob", glob)
            .option("rangebytes", str(range_bytes)).load())
